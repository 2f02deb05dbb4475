import pytest

from veritab.llm import mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), total=1.5, most=2.0):
    """Share by weight, cut what is over, share that again, until nothing is over."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), total * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            room = most * sizes[s] - target[s]
            target[s] += min(x, room)
            if x >= room:
                left += x - room
                open_.discard(s)
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 500, None: 90},
        {"a": 1},
        {"a": 5, "b": 0, "c": 7},
        {f"s{k}": (k * 37) % 101 + 1 for k in range(25)},
    ],
)
def test_targets_equal_repeated_sharing(spark, sizes):
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_words_come_near_targets_and_reruns_agree(spark, documents):
    table = documents.unionByName(documents.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "'src0' AS source", "n_chars"))
    first = mixing.allocate(table).collect()
    again = mixing.allocate(table.repartition(7)).collect()
    assert {(r.key, r.source, r.copies) for r in first} == {(r.key, r.source, r.copies) for r in again}
    assert all(r["copies"] <= 2 for r in first)
    taken = sum(r["size"] * r["copies"] for r in first)
    assert taken == pytest.approx(1.5 * sum(r["size"] for r in first), rel=0.15)


def test_mix_emits_the_copies_allocated(odd_documents, documents):
    for table in (documents, odd_documents):
        allocated = sum(r.copies for r in mixing.allocate(table).collect())
        mixed = mixing.mix(table)
        assert mixed.columns == table.columns
        assert mixed.count() == allocated


def test_empty_table(no_documents):
    assert mixing.allocate(no_documents).count() == 0
    assert mixing.mix(no_documents).count() == 0
