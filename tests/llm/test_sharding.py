import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import sharding
from veritab.llm.queries import op11_sharding

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation_is_one_and_can_be_undone(n):
    p = sharding.Permutation(n, seed=3)
    numbers = np.arange(n)
    to = p.forward(numbers)
    assert sorted(to.tolist()) == numbers.tolist()
    assert (p.backward(to) == numbers).all()
    shard, slot = p.place(numbers, 7)
    assert (p.number(shard, slot, 7) == numbers).all()


def test_large_numbers_and_bounds():
    p = sharding.Permutation(10**15 + 7)
    numbers = np.array([0, 1, 10**9, 10**15 + 6])
    to = p.forward(numbers)
    assert len(set(to.tolist())) == 4 and to.max() < p.n
    assert (p.backward(to) == numbers).all()
    for wrong in (-1, p.n):
        with pytest.raises(ValueError):
            p.forward(np.array([wrong]))


def test_seed_and_order_matter():
    numbers = np.arange(10_000)
    one, two = (sharding.Permutation(10_000, s).forward(numbers) for s in (1, 2))
    assert (one == two).mean() < 0.01
    # Neighbours don't stay together.
    assert np.abs(np.corrcoef(numbers, one)[0, 1]) < 0.05


def _check(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards)) and (len(rows) < shards or len(sizes) == shards)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_query(spark):
    rows = op11_sharding(spark, DATA).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    _check(rows, 40)
    by_id = sorted(rows, key=lambda r: r["doc_id"])
    assert [r["row_number"] for r in by_id] == list(range(len(rows)))
    shard, slot = sharding.Permutation(len(rows)).place(np.arange(len(rows)))
    for k, r in enumerate(by_id):
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (shard[k], slot[k], "rows", None)


def test_reruns_and_partitions_agree(spark, documents):
    place = lambda d: sorted(map(tuple, sharding.shard(d).select("doc_id", "shard", "slot").collect()))
    assert place(documents.repartition(1)) == place(documents.repartition(13, F.rand(7)))


@pytest.mark.parametrize("at_once", [1, 2, 100_000])
def test_odd_rows(spark, odd_documents, at_once):
    extra = odd_documents.withColumn("Shard", F.lit("x")).withColumn("_n", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), "text"))
    rows = sharding.shard(extra, 5, at_once=at_once).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_documents.collect())
    assert {"Shard", "shard_", "slot", "row_number", "text", "m"} <= set(rows[0].asDict())
    _check([{"shard": r["shard_"], "slot": r["slot"]} for r in rows], 5)
    # Null keys come last.
    assert {r["row_number"] for r in rows if r["doc_id"] is None} == {len(rows) - 1, len(rows) - 2}


def test_many_equal_rows(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard(df.unionByName(spark.range(10).selectExpr("id as doc_id", "'other' as text")), 40, at_once=64).collect()
    assert len(rows) == 3010 and sorted(r["row_number"] for r in rows) == list(range(3010))
    _check(rows, 40)


def test_empty(no_documents):
    assert sharding.shard(no_documents).collect() == []
