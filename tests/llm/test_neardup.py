import random

import numpy as np
import pytest

from veritab.llm import neardup
from veritab.llm.components import components


def shingle_set(text, length):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    k = min(length, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, length, percent):
    """Component id of each key by comparing all pairs; keys distinct."""
    sets = [(k, shingle_set(t, length)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k, _ in sets}


def mutated(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(k, mutated(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 9]))) for k in range(220)]
    rows += [(1000 + k, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80)))) for k in range(150)]
    rows += [(2000 + k, rows[-1 - k][1].upper()) for k in range(40)]
    return rows


@pytest.mark.parametrize(("length", "percent"), [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, copies, length, percent):
    table = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.key: r.component_id for r in neardup.groups(table, length=length, percent=percent).collect()}
    assert got == brute(copies, length, percent)


def test_blocks_do_not_matter(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 20)
    table = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.key: r.component_id for r in neardup.groups(table).collect()}
    assert got == brute(copies, 3, 85)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = neardup.groups(documents).collect()
    assert {r.key: r.component_id for r in got} == brute(rows, 3, 85)
    assert {r.key: r.n_shingles for r in got} == {k: len(shingle_set(t, 3)) for k, t in rows}
    assert all(r.kept == (r.key == r.component_id) for r in got)


def test_odd_rows(odd_documents, no_documents):
    got = neardup.groups(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_key = {r.key: r for r in got}
    assert [by_key[k].n_shingles for k in (1, 2, 3)] == [0, 0, 0]
    assert [by_key[k].component_id for k in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 4]
    assert by_key[7].component_id == 6 and not by_key[7].kept
    assert neardup.groups(no_documents).count() == 0


def test_one_row_of_each_group_stays(odd_documents, documents):
    kept = neardup.deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 8, 9]
    twice = documents.union(documents)
    assert neardup.deduplicate(twice).count() == neardup.groups(documents).where("kept").count()


@pytest.mark.parametrize("key", [None, 7])
def test_a_key_of_many_rows_multiplies_nothing(spark, monkeypatch, key):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{k}x{rng.randrange(3000)}" for _ in range(60)]
        rows += [(key, " ".join(words)), (key, " ".join(words[:-1]))]
    fetched = []

    def kept(*tables, fetch=neardup._with_text):
        fetched.append(fetch(*tables))
        return fetched[0]

    monkeypatch.setattr(neardup, "_with_text", kept)
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 120
    assert fetched[0].count() == fetched[0].select("node").distinct().count() == 120


def test_rows_are_kept_by_row_not_by_key(spark):
    rng = random.Random(9)
    a, b, c, d = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(4))
    whole = lambda words: " ".join(words)
    near = lambda words: " ".join(words[:-1])
    big = 2**60 + 1
    rows = [
        (5, whole(a), 1), (5, whole(b), 2),  # one key, two groups: both stay
        (3, near(b), 3),  # and the second text's group is named by another key, so it goes
        (None, whole(c), 4), (None, whole(c), 5), (None, near(c), 6),  # a group without a key keeps one row
        (None, near(a), 7),  # goes with its named copy
        (big, whole(d), 8), (big, whole(d), 8),
        (9, "", 9), (9, "", 9), (None, "", 10), (None, None, 11),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = neardup.deduplicate(table).collect()
    assert sorted(r.n for r in kept if r.n not in (4, 5, 6)) == [1, 3, 8, 9, 10, 11]
    assert sum(r.n in (4, 5, 6) for r in kept) == 1
    assert {r.doc_id for r in kept} == {5, 3, None, big, 9}
    assert neardup.groups(table).where("kept").count() == len(kept)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert np.array_equal(np.maximum(ra, rb), neardup.registers(np.union1d(a, b)))
    assert abs(neardup.estimate(ra, 4000, rb[None], np.array([4000]))[0] - 0.6) < 0.15


def test_missed_pairs_are_rare():
    for percent in (80, 85, 90):
        rows = neardup.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (neardup.REGISTERS // rows) <= neardup.MISSED


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(40)] + [(500, 500)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(200, 240), 200)}
