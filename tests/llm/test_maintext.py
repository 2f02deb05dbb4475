import random
import re
from html import unescape

import pytest

from tests.llm.conftest import DATA
from veritab.llm import maintext
from veritab.llm.dom import parse
from veritab.llm.queries import QUERIES


@pytest.fixture(scope="module")
def forest(pages):
    return maintext.train(pages, sample=25)


def article_of(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())


def test_articles_of_the_pages(pages, forest):
    got = maintext.main_text(pages, forest).collect()
    assert len(got) == pages.count()
    right = sum(r.text == article_of(r.html) for r in got)
    assert right >= 0.98 * len(got)


def test_held_out_frames(pages, forest):
    """Share of words right in frames that training has not seen."""
    rng = random.Random(99)
    texts = [maintext.texts_of(r.html) for r in pages.orderBy("page_id").limit(20).collect()]
    kept = wrong = 0
    for own in texts:
        page, labels = maintext.training_page(own, rng)
        tree = maintext.Tree(parse(page))
        want = {
            k
            for k in range(1, len(tree.nodes))
            if labels[k - 1] and tree.own[k] and not tree.gone[k]
        }
        decoded = tree.decode(forest.log_odds(tree.features()))
        got = {k for k in range(1, len(tree.nodes)) if decoded[k] and tree.own[k]}
        kept += sum(tree.own[k] for k in want)
        wrong += sum(tree.own[k] for k in want ^ got)
    assert wrong < 0.2 * kept


def test_choices_are_consistent(pages, forest):
    tree = maintext.Tree(parse(pages.first().html))
    kept = tree.decode(forest.log_odds(tree.features()))
    for k in range(1, len(kept)):
        if tree.gone[k]:
            assert not kept[k]


def test_decoding_is_the_best_consistent_choice():
    tree = maintext.Tree(parse("<div>aa<p>bbb</p><p>c</p></div><div>dd<p>ee</p></div>"))
    rng = random.Random(3)
    import itertools

    import numpy as np

    for _ in range(30):
        odds = np.array([rng.uniform(-1, 1) for _ in tree.nodes])
        weight = odds * np.where(tree.own > 0, 1.0 + np.log1p(tree.own), 0.1)

        def value(choice):
            total = 0.0
            for k, c in enumerate(choice):
                p = tree.nodes[k].parent
                if p >= 0 and choice[p] != "split" and c != choice[p]:
                    return -np.inf
                if c == "take":
                    total += weight[k]
                elif c == "split":
                    total += max(0.0, weight[k] if tree.own[k] else 0.0) - maintext.SPLIT_COST
            return total

        best = max(itertools.product(["take", "drop", "split"], repeat=len(tree.nodes)), key=value)
        want = [c == "take" or c == "split" and tree.own[k] > 0 and weight[k] > 0 for k, c in enumerate(best)]
        assert tree.decode(odds) == want


def test_parser_survives_bad_markup():
    for page in ["<", "<p", "<p>a<p>b", "</div>x", "<script>var a='</p>'", "<!-- x", "<a href='>'>y</a>", "<div " * 50,
                 "<div>" * 3000 + "deep", "&amp;&bad;&#65;", "<td>a<td>b<tr><li>c<li>d", "<b><p>x</b></p>", "a < b"]:
        nodes = parse(page)
        assert nodes and all(n.parent < k for k, n in enumerate(nodes))


def test_white_space_and_references(forest):
    page = "<html><body><article><h1>A  title</h1><p>One&nbsp;&amp;\n two <b>thr</b>ee.<br>Four words, and more text.</p></article></body></html>"
    assert maintext.extract(page, forest) == "A title One & two three. Four words, and more text."


def test_odd_rows(spark, forest):
    table = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "<html></html>", None), (4, "<p>" + "long text. " * 20_000, "y")],
        "page_id long, html string, text string",
    )
    got = maintext.main_text(table, forest)
    rows = {r.page_id: r["text_"] for r in got.collect()}
    assert got.count() == 5 and rows[1] == rows[2] == rows[3] == ""
    empty = table.where("page_id < 0")
    assert maintext.train(empty) is None
    assert maintext.main_text(empty, None).count() == 0


ARTICLE = ["The river had been rising for three days, and nobody in the village slept well. " * 2,
           "On the fourth morning the water turned, and the people came out to look at the fields. " * 2,
           "They found their fences gone, their wells filled with mud, and their cattle on the hill. " * 2]


def test_articles_in_odd_places(forest):
    body = "".join(f"<p>{t}</p>" for t in ARTICLE)
    whole = " ".join(" ".join(ARTICLE).split())
    menu = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul>'
    pages = {
        "form": f"<html><body><form action='x'><input name='q'><div class='content'>{body}</div></form></body></html>",
        "nav": f"<html><body><nav>{menu}<article>{body}</article></body></html>",
        "noscript": f"<html><body><noscript><article>{body}</article></body></html>",
        "one paragraph": f"<p>{whole}</p>",
        "bare": whole,
        "plain": f"<html><body><nav>{menu}</nav><article>{body}</article><footer>Imprint of the paper.</footer></body></html>",
        "aside": f"<html><body><article>{body}</article><aside>Read this as well, it is short.</aside></body></html>",
    }
    got = {name: maintext.extract(page, forest) for name, page in pages.items()}
    assert got == {name: whole for name in pages}


def test_query_returns_every_page(spark, pages):
    got = QUERIES["op8_html_extraction"](spark, DATA).collect()
    source = {r.page_id: r for r in pages.collect()}
    assert len(got) == pages.count() and all(r.url == source[r.page_id].url and r.n_chars == len(r.text) for r in got)
    right = sum(r.text == article_of(source[r.page_id].html) for r in got)
    assert right >= 0.98 * len(got)
