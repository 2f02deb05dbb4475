"""A small DOM for pages as they are: open tags, stray ends, raw text. Only what main-text extraction needs."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard, by their part in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Raw elements whose missing end doesn't swallow what follows.
UNCLOSED = frozenset("title noscript iframe noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: An element of the key is closed by the start of one of the values, unless a boundary lies between.
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 "
        "h6 header hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
BOUNDARY = {
    "li": frozenset(["ul", "ol", "menu"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["table"]),
    "th": frozenset(["table"]),
    "option": frozenset(["select"]),
    "p": frozenset(["table", "td", "th", "button", "object"]),
    "head": frozenset(),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Stands in the text of a node where a line break or the edge of a block was.
BREAK = "\n"


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    #: Texts and numbers of children, in page order.
    inside: list[str | int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """The elements of a page in page order; number 0 is a root without a tag. Every character is looked at once."""
    nodes = [Node("", -1, 0)]
    stack = [0]
    at = 0

    def text(part: str) -> None:
        if part:
            nodes[stack[-1]].inside.append(html.unescape(part) if "&" in part else part)

    def close(tags: frozenset[str] | tuple[str, ...], boundary: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                del stack[k:]
                return
            if tag in boundary:
                return

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return nodes
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                nodes[stack[-1]].inside.append(BREAK)
            elif tag not in VOID:
                close((tag,), frozenset() if tag not in INLINE else frozenset(["body", "td", "th", "table"]))
            continue
        for open_tag, starts in CLOSED_BY.items():
            if tag in starts:
                close((open_tag,), BOUNDARY[open_tag])
        number = len(nodes)
        nodes[stack[-1]].inside.append(number)
        nodes.append(Node(tag, stack[-1], len(stack), m[3]))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            # Without an end, those that only hold text leave the rest of the page to the page.
            at = end.end() if end else at if tag in UNCLOSED else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(number)


def attribute_words(node: Node) -> list[str]:
    """Lower-case words of class, id and role: ``class="sideBar ad-box"`` gives side, bar, sidebar, ad, box."""
    found: list[str] = []
    for m in ATTRIBUTE.finditer(node.attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
            value = html.unescape(m[2] or m[3] or m[4] or "")
            for word in re.split(r"[^A-Za-z]+", value):
                parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", word)
                found += [p.lower() for p in parts]
                if len(parts) > 1:
                    found.append(word.lower())
    return found
