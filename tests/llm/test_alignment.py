import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.llm import alignment
from veritab.llm.queries import op13_token_alignment
from veritab.llm.vocabulary import VOCABULARY

DATA = "/root/testdata/sf0.001"
ENDS = st.lists(st.integers(1, 400), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS)
def test_gallop(short, long):
    got = alignment.gallop(np.array(short, np.int64), np.array(long, np.int64))
    assert got.tolist() == [bisect_left(long, s) for s in short]


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS)
def test_meet(short, long):
    end = max([1, *short, *long])
    short, long = sorted({*short, end}), sorted({*long, end})
    at_short, at_long, first, count = alignment.meet(np.array(short), np.array(long))
    common = sorted(set(short) & set(long))
    assert [short[k] for k in at_short] == common and [long[k] for k in at_long] == common
    links = [(i, f + k) for i, (f, n) in enumerate(zip(first.tolist(), count.tolist())) for k in range(n)]
    starts = lambda ends: [0, *ends[:-1]]
    want = [
        (i, j)
        for i, (a, b) in enumerate(zip(starts(short), short))
        for j, (c, d) in enumerate(zip(starts(long), long))
        if max(a, c) < min(b, d)
    ]
    assert links == want


@pytest.fixture(scope="module")
def tokenizers():
    with open(alignment.BYTE_LEVEL, encoding="utf-8") as a, open(VOCABULARY, "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


def spans(tokenizers, text):
    """(A, B) as lists of (id, start, end), or None."""
    if not text:
        return None
    both = []
    for ids, table in (
        (tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.a_bytes),
        (tokenizers.b.encode(text), tokenizers.b_bytes),
    ):
        end, out = 0, []
        for i in ids:
            out.append((i, end, end + len(table[i])))
            end += len(table[i])
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        both.append(out)
    return both


def brute(tokenizers, texts):
    """What the query says of each text, by comparing the spans of all tokens near each other."""
    documents, counts = [], Counter()
    for text in texts:
        found = spans(tokenizers, text)
        if found is None:
            documents.append(None)
            continue
        a, b = found
        links, start = [], 0
        for i, begin, end in a:
            while b[start][2] <= begin:
                start += 1
            k = start
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        common = sorted({t[2] for t in a} & {t[2] for t in b})
        groups = [([], []) for _ in common]
        for side, tokens in enumerate((a, b)):
            for i, _, end in tokens:
                groups[bisect_left(common, end)][side].append(str(i))
        written = ";".join("|".join(map(",".join, g)) for g in groups)
        counts.update(set(links))
        documents.append((len(a), len(b), len(common), links, written))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if d is None
        else (*d[:3], len(d[3]), sum(counts[x] == highest[x[0]] for x in d[3]), sum(counts[x] for x in d[3]), d[4])
        for d in documents
    ]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_query_against_brute_force(spark, documents, tokenizers):
    some = documents.select("doc_id", "text").orderBy("doc_id").collect()
    want = dict(zip((r["doc_id"] for r in some), brute(tokenizers, [r["text"] for r in some])))
    rows = op13_token_alignment(spark, DATA).collect()
    assert len(rows) == len(some)
    for r in rows:
        *numbers, written = want[r["doc_id"]]
        assert [r[c] for c in NUMBERS] == numbers
        assert r["groups_sha256"] == (hashlib.sha256(written.encode()).hexdigest() if written else "")


@pytest.mark.parametrize(("block_bytes", "part"), [(1, 100_000), (4_000_000, 20)])
def test_odd_rows(odd_documents, tokenizers, block_bytes, part):
    more = odd_documents.withColumn("n_a", F.lit("mine")).withColumn("groups", F.lit(0))
    rows = alignment.align(more, block_bytes=block_bytes, part=part).collect()
    assert sorted(rows[0].asDict()) == sorted(
        [*more.columns, "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_"]
    )
    want = brute(tokenizers, [r["text"] for r in rows])
    assert len(rows) == odd_documents.count()
    for r, w in zip(rows, want):
        assert (r["n_a_"], *[r[c] for c in NUMBERS[1:]], r["groups_"]) == w


TEXTS = [
    "<|endoftext|> and <s> </s> <unk> are plain",
    "<0x41> ▁ mark",
    "  two blanks  and\ttabs\n\n",
    " ",
    "naïve café 東京 \U0001f600\U0001f469‍\U0001f680 ñ",
    "á   　 ﻿",
    "x" * 3000,
    "\x00\x01",
    "word",
    "word",
]


def test_awkward_texts(spark, tokenizers):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = alignment.align(df).orderBy("doc_id").collect()
    want = brute(tokenizers, TEXTS)
    for r, w in zip(rows, want):
        assert (*[r[c] for c in NUMBERS], r["groups"]) == w
    assert want[0][0] > 0 and want[1][0] == 0  # special tokens are text; a mark in the text isn't given back


def test_parts_have_the_tokens_of_the_whole(tokenizers):
    text = "Some words, 12 numbers 3 4 and l'été  with  gaps\nlines don't end. " * 40
    assert len(tokenizers.parts(text, 50)) > 20 and "".join(tokenizers.parts(text, 50)) == " " + text
    for whole, cut in zip(tokenizers.encode([text], 10**9), tokenizers.encode([text], 50)):
        assert whole[0].tolist() == cut[0].tolist()


def test_empty(no_documents):
    assert alignment.align(no_documents).collect() == []
