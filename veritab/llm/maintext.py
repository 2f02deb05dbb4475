"""Main text of web pages: boosted trees score DOM nodes, a tree decoding keeps the choices consistent.

Features of a node: text and tag density of its subtree, share of link text, sentence ends, depth, position and
likeness among siblings, words of its attributes and those of its ancestors. The trees are fitted by Spark ML on a
bounded sample of pages: the texts of each sampled page are laid out anew in several page frames (with and without
landmark elements, with and without telling class names), so each node's label is known: 1 inside the article, 0 in
menus, headers, footers, sidebars, notices, adverts, forms and comments.

Decoding: a subtree is taken whole, dropped whole, or split, in which case its children decide for themselves at a
fixed cost. The best choice for all nodes of a page is found bottom-up in one pass, so no node is kept below a
dropped one and none is dropped below one that is kept whole. Elements that never hold reading text (scripts,
styles, controls) are dropped before, and so are forms, navigation, asides and footers, but not where such an element
holds more than half of the page's text, as a form around the page or a menu without its end does: then the trees
judge what is in it. If nothing is kept, blocks with own text that are no links, and that no word of their attributes or
of those above them speaks against, are the article: a page of one paragraph, or of text without any element, is one.

Text: character references are decoded, white space inside a block becomes one blank, blocks are joined by one
blank in page order. Defined cases: null and empty pages give an empty text, as does a page without an article. Text
outside any element is judged as a child of the root. Repeated rows are treated alike; an empty table gives no rows
(and needs no model). Other columns are kept; added names get underscores where they clash.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name
from veritab.llm.dom import BREAK, INLINE, RAW, Node, attribute_words, parse
from veritab.llm.vocabulary import bound_batches

#: Pages whose texts the training frames are filled with, at most.
SAMPLE_PAGES = 60
TREES, DEPTH = 20, 4
SPLIT_COST = 1.0

# Element names and attribute words with a usual meaning.
DROPPED = RAW | frozenset(
    "head nav footer aside form button select input menu dialog svg canvas audio video object embed applet map "
    "datalist meter progress fieldset".split()
)
#: Of these, what may wrap a whole page by mistake or by habit.
WRAPPERS = frozenset("nav footer aside form menu dialog fieldset".split())
LANDMARKS = ("article", "main", "header", "section", "table", "li", "p", "h1", "h2", "h3", "blockquote", "pre", "div")
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar cookie cookies "
    "consent gdpr notice alert warning popup modal overlay newsletter subscribe signup login search share social "
    "related recommended trending comment comments reply replies respond discussion disqus feedback rating widget "
    "pagination pager copyright legal disclaimer tags skip".split()
)
GOOD_WORDS = frozenset("article content post entry story main text prose body page copy hentry articlebody".split())
SENTENCE = re.compile(r"[.!?…](?:\s|$)")


class Tree:
    """Nodes of one page with the sums that the features need."""

    def __init__(self, nodes: list[Node]) -> None:
        n = len(nodes)
        self.nodes = nodes
        self.chars, self.link_chars, self.stops, self.words = (np.zeros(n) for _ in range(4))
        self.elements, self.paragraphs = np.ones(n), np.zeros(n)
        self.gone = [False] * n
        self.bad, self.good, self.above_bad, self.above_good = (np.zeros(n) for _ in range(4))
        self.children: list[list[int]] = [[] for _ in range(n)]
        linked = [False] * n
        wraps = self._wrappers()
        for k, node in enumerate(nodes):
            p = node.parent
            if p >= 0:
                self.children[p].append(k)
                self.gone[k] = self.gone[p] or node.tag in DROPPED and k not in wraps
                linked[k] = linked[p] or node.tag == "a"
                self.above_bad[k] = self.above_bad[p] + self.bad[p]
                self.above_good[k] = self.above_good[p] + self.good[p] + (nodes[p].tag in ("article", "main"))
            if "=" in node.attributes:
                words = attribute_words(node)
                self.bad[k] = sum(w in BAD_WORDS for w in words)
                self.good[k] = sum(w in GOOD_WORDS for w in words)
            for part in node.inside:
                if isinstance(part, str) and not part.isspace():
                    self.chars[k] += len(part)
                    self.words[k] += part.count(" ") + 1
                    self.stops[k] += len(SENTENCE.findall(part))
            if linked[k]:
                self.link_chars[k] = self.chars[k]
            self.paragraphs[k] = node.tag == "p"
        self.own = self.chars.copy()
        for k in range(n - 1, 0, -1):
            p = nodes[k].parent
            if not self.gone[k]:
                for sums in (self.chars, self.link_chars, self.stops, self.words, self.elements, self.paragraphs):
                    sums[p] += sums[k]

    def _wrappers(self) -> set[int]:
        """Elements of WRAPPERS with more than half of the page's text."""
        nodes = self.nodes
        if not any(node.tag in WRAPPERS for node in nodes):
            return set()
        held = [
            0 if node.tag in DROPPED and node.tag not in WRAPPERS
            else sum(len(part) for part in node.inside if isinstance(part, str) and not part.isspace())
            for node in nodes
        ]
        lost = [False] * len(nodes)
        for k, node in enumerate(nodes):
            lost[k] = k > 0 and (lost[node.parent] or node.tag in DROPPED and node.tag not in WRAPPERS)
            held[k] = 0 if lost[k] else held[k]
        for k in range(len(nodes) - 1, 0, -1):
            held[nodes[k].parent] += held[k]
        return {k for k, node in enumerate(nodes) if node.tag in WRAPPERS and 2 * held[k] > held[0]}

    def features(self) -> np.ndarray:
        n = len(self.nodes)
        out = np.zeros((n, 20 + len(LANDMARKS)))
        total = max(1.0, self.chars[0])
        siblings = np.ones(n)
        place = np.zeros(n)
        same = np.zeros(n)
        longest = np.zeros(n)
        for kids in self.children:
            tags: dict[str, int] = {}
            for c in kids:
                tags[self.nodes[c].tag] = tags.get(self.nodes[c].tag, 0) + 1
            most = max((self.chars[c] for c in kids), default=0.0)
            for place_of, c in enumerate(kids):
                siblings[c], place[c] = len(kids), place_of / len(kids)
                same[c], longest[c] = tags[self.nodes[c].tag] / len(kids), self.chars[c] / max(1.0, most)
        columns = [
            np.log1p(self.chars),
            np.log1p(self.own),
            self.chars / total,
            self.chars / self.elements,
            self.link_chars / np.maximum(1.0, self.chars),
            self.stops / np.maximum(1.0, self.words),
            np.log1p(self.words),
            self.chars / np.maximum(1.0, self.words),
            np.log1p(self.elements),
            self.paragraphs,
            np.array([node.depth for node in self.nodes], float),
            siblings,
            place,
            same,
            longest,
            self.bad,
            self.good,
            self.above_bad,
            self.above_good,
            np.arange(n) / n,
        ]
        for c, values in enumerate(columns):
            out[:, c] = values
        for k, node in enumerate(self.nodes):
            if node.tag in LANDMARKS:
                out[k, 20 + LANDMARKS.index(node.tag)] = 1.0
        return out

    def decode(self, log_odds: np.ndarray) -> list[bool]:
        """Which nodes' own texts are kept, by the best consistent choice of take, drop and split."""
        n = len(self.nodes)
        # What a node says counts for the text it holds itself; blocks without own text only settle ties.
        weight = log_odds * np.where(self.own > 0, 1.0 + np.log1p(self.own), 0.1)
        take, drop, best = np.zeros(n), np.zeros(n), np.zeros(n)
        choice = [""] * n
        for k in range(n - 1, -1, -1):
            kids = [c for c in self.children[k] if not self.gone[c]]
            take[k] = weight[k] + sum(take[c] for c in kids)
            split = -SPLIT_COST + sum(best[c] for c in kids) + max(0.0, weight[k] if self.own[k] else 0.0)
            best[k], choice[k] = max((take[k], "take"), (0.0, "drop"), (split, "split"))
        kept = [False] * n
        for k in range(n):
            p = self.nodes[k].parent
            if self.gone[k]:
                choice[k] = "drop"
            elif p >= 0 and choice[p] != "split":
                choice[k] = choice[p]
            kept[k] = choice[k] == "take" or choice[k] == "split" and self.own[k] > 0 and weight[k] > 0
        if not any(kept[k] and self.own[k] for k in range(n)):
            kept = [
                self.own[k] > 0 and not self.gone[k] and self.link_chars[k] == 0 and self.bad[k] + self.above_bad[k] == 0
                and self.stops[k] > 0
                for k in range(n)
            ]
        return kept

    def text(self, kept: list[bool]) -> str:
        parts: list[str] = []
        pending: list[tuple[int, int]] = [(0, 0)]
        while pending:  # pages may nest deeper than Python's calls
            k, at = pending.pop()
            node = self.nodes[k]
            if at == 0 and node.tag not in INLINE:
                parts.append(BREAK)
            while at < len(node.inside):
                part = node.inside[at]
                at += 1
                if isinstance(part, int):
                    if not self.gone[part]:
                        pending += [(k, at), (part, 0)]
                        break
                    if self.nodes[part].tag not in INLINE:
                        parts.append(BREAK)
                elif kept[k]:
                    parts.append(part)
            else:
                if node.tag not in INLINE:
                    parts.append(BREAK)
        return " ".join("".join(parts).split())


class Forest:
    """Boosted trees as arrays: feature, threshold, left and right child or value of each node."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float]) -> None:
        self.trees = [tuple(np.array(column) for column in zip(*t)) for t in trees]
        self.weights = weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                leaf = left[at] < 0
                down = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                at = np.where(leaf, at, down)
            total += weight * value[at]
        return 2.0 * total


def _arrays(root) -> list[tuple[int, float, int, int, float]]:
    out: list[list] = []

    def walk(node) -> int:
        k = len(out)
        out.append([0, 0.0, -1, -1, node.prediction()])
        if node.subtreeDepth() > 0:
            out[k][0], out[k][1] = node.split().featureIndex(), node.split().threshold()
            out[k][2] = walk(node.leftChild())
            out[k][3] = walk(node.rightChild())
        return k

    walk(root)
    return [tuple(x) for x in out]


def texts_of(page: str) -> list[str]:
    """Sentences and lines of a page, longest first: raw material for the training frames."""
    tree = Tree(parse(page))
    found = [
        " ".join(part.split())
        for k, node in enumerate(tree.nodes)
        if not tree.gone[k]
        for part in node.inside
        if isinstance(part, str) and not part.isspace()
    ]
    return sorted(found, key=len, reverse=True)


def training_page(texts: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page in a random frame, and for each of its elements whether it is the article or inside it."""
    spare = [t for t in texts if t] or ["text"]
    pieces: list[str] = []
    labels: list[bool] = []

    def attribute(words: list[str], chance: float) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(words)}"' if words and rng.random() < chance else ""

    def put(tag: str, good: bool, inside, words: list[str] = (), chance: float = 0.8) -> None:
        labels.append(good)
        pieces.append(f"<{tag}{attribute(list(words), chance)}>")
        inside()
        pieces.append(f"</{tag}>")

    def say(text: str) -> None:
        pieces.append(text.replace("&", "&amp;").replace("<", "&lt;"))

    def short(words: int) -> str:
        return " ".join(rng.choice(spare).split()[:words]) or "x"

    def sentence() -> str:
        whole = rng.choice(spare).split()
        start = rng.randrange(max(1, len(whole) - 8))
        return " ".join(whole[start : start + rng.randint(5, 25)])

    def links() -> None:
        for _ in range(rng.randint(2, 9)):
            put("li", False, lambda: put("a", False, lambda: say(short(rng.randint(1, 4)))))

    def small(tag: str = "p") -> None:
        for _ in range(rng.randint(1, 3)):
            put(tag, False, lambda: say(sentence()))

    def article() -> None:
        put("h1", True, lambda: say(short(9)), ["title", "headline"], 0.3)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                put("p", True, lambda: say(rng.choice(spare)))
            elif kind < 0.85:
                put("h2", True, lambda: say(short(6)))
            elif kind < 0.93:
                put("ul", True, lambda: [put("li", True, lambda: say(sentence())) for _ in range(3)])
            else:
                put("blockquote", True, lambda: say(sentence()))
            if rng.random() < 0.08:
                put("div", False, lambda: say(sentence()), ["ad", "ads", "advert", "promo", "related"], 1.0)

    def aside(words: list[str], inside) -> None:
        put(rng.choice(["div", "section", "div"]), False, inside, words, 0.9)

    def comments() -> None:
        for _ in range(rng.randint(1, 4)):
            put("div", False, lambda: put("p", False, lambda: say(rng.choice(spare))), ["comment", "reply"], 0.9)

    def body() -> None:
        if rng.random() < 0.6:
            put(rng.choice(["header", "div"]), False, lambda: say(short(6)), ["header", "masthead", "banner"], 0.9)
        if rng.random() < 0.5:
            aside(["menu", "navbar", "navigation", "breadcrumbs"], lambda: put("ul", False, links))
        if rng.random() < 0.4:
            aside(["cookie-notice", "notice", "alert", "consent"], small)
        if rng.random() < 0.6:
            aside(["ad", "ads", "advert", "sponsored", "promo"], lambda: say(sentence()))
        frame = rng.choice(["article", "main", "div", "section", "td"])
        words = ["content", "post", "entry", "article-body", "story", "main-text", "x1", "col"]
        if frame == "td":
            put("table", False, lambda: put("tr", False, lambda: put("td", True, article, words, 0.5)))
        else:
            put(frame, True, article, words, 0.3 if frame in ("article", "main") else 0.7)
        if rng.random() < 0.4:
            aside(["comments", "discussion", "replies", "respond"], comments)
        if rng.random() < 0.4:
            aside(["sidebar", "related", "widget", "recommended"], rng.choice([small, lambda: put("ul", False, links)]))
        if rng.random() < 0.5:
            aside(["footer", "copyright", "legal", "page-foot"], lambda: say(sentence()))

    put("html", False, lambda: put("body", False, body))
    return "".join(pieces), labels


def train(
    pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, frames: int = 8, seed: int = 1
) -> Forest | None:
    """Trees fitted on frames filled with the texts of ``sample`` pages, those with the lowest hashes."""
    spark = pages.sparkSession
    hashed = pages.where(F.length(html) > 0).select(F.col(html).alias("h"), F.xxhash64(html).alias("k"))
    # Hashes first: a sorted limit sends the rows it may keep of every task to the driver.
    lowest = [r["k"] for r in hashed.select("k").distinct().orderBy("k").limit(sample).collect()]
    chosen = hashed.where(F.col("k").isin(lowest)).dropDuplicates(["k"]).collect() if lowest else []  # ``sample`` rows
    texts = [t for r in sorted(chosen, key=lambda r: r["k"]) if (t := texts_of(r["h"]))]
    if not texts:
        return None
    rng = random.Random(seed)
    x, y = [], []
    for own in texts:
        for _ in range(frames):
            page, labels = training_page(own, rng)
            tree = Tree(parse(page))
            if len(tree.nodes) == len(labels) + 1:
                keep = [k for k in range(1, len(tree.nodes)) if not tree.gone[k]]
                x.append(tree.features()[keep])
                y.append(np.array(labels)[np.array(keep) - 1])
    rows = [(a, float(b)) for a, b in zip(np.concatenate(x).tolist(), np.concatenate(y).tolist())]
    table = spark.createDataFrame(rows, "x array<double>, label double").select(
        array_to_vector("x").alias("features"), "label"
    )
    table = table.coalesce(1)  # a bounded sample
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, stepSize=0.3).fit(table.cache())
    table.unpersist()
    return Forest([_arrays(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def extract(page: str | None, forest: Forest | None) -> str:
    tree = Tree(parse(page or ""))
    if forest is None or len(tree.nodes) == 1 and not tree.own[0]:
        return ""
    return tree.text(tree.decode(forest.log_odds(tree.features())))


def main_text(df: DataFrame, forest: Forest | None, html: str = "html") -> DataFrame:
    """``df`` with the column ``text``: the main text of each page."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            trees = [Tree(parse(p or "")) for p in batch.where(batch.notna(), None)]
            if shared.value is None:
                yield pd.Series([""] * len(trees))
                continue
            sizes = np.cumsum([len(t.nodes) for t in trees])[:-1]
            odds = np.split(shared.value.log_odds(np.concatenate([t.features() for t in trees])), sizes) if trees else []
            yield pd.Series([t.text(t.decode(o)) for t, o in zip(trees, odds)], dtype=object)

    return df.withColumn(fresh_name(df, "text"), of(df[html]))
