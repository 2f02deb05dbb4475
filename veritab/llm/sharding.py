"""Shards by a shuffle in which every place can be computed.

Rows get global numbers from 0 in the order of their key, nulls last, then of a hash of the whole row. A Feistel
network permutes those numbers: 2 b bits are split in halves, and each round adds a keyed hash of one half to the
other, which can be undone whatever the hash is. The smallest even number of bits that holds all numbers may also hold
others; a number that is led out of range is permuted on until it comes back (cycle walking), so what remains is a
permutation of exactly the rows. Permuted number p stands in shard p mod ``shards`` at slot p div ``shards``: shard
sizes are at most one row apart, slots have no gaps, and ``Permutation`` tells place from number and number from place
without any table.

How rows are numbered: equal rows are counted first, in every task before the shuffle. The distinct ones are split into
ranges of the order and written with the number of their range; the rows of a range are counted, summed over the few
ranges, and numbered within it. No key, however frequent, gathers in one task, since each distinct row is one, and the
copies of a row that has very many are made in several tasks. The numbers depend on the rows only, never on files,
partitions or lost executors.

Defined cases: null keys come last; equal keys are told apart by their rows' hashes; equal rows are alike, so any of
them may have any of their numbers. An empty table gives no rows. All columns are kept; added names get underscores
where they clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name
from veritab.session import durable

SHARDS = 40
SEED = 1
ROUNDS = 6
#: Odd 32-bit multipliers of the round's hash.
FIRST, SECOND = 0x9E3779B1, 0x85EBCA6B
#: Copies of one row that a task makes at once.
AT_ONCE = 100_000


class Permutation:
    """A permutation of 0 to n - 1, by seed; ``forward`` and ``backward`` undo each other."""

    def __init__(self, n: int, seed: int = SEED) -> None:
        if not 0 <= n <= 1 << 62:
            raise ValueError("numbers must fit in 62 bits")
        self.n = n
        self.half = max(1, -(-max(n - 1, 0).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.keys = [(seed * FIRST + r * SECOND + 1) % (1 << 32) for r in range(ROUNDS)]

    def _hash(self, x: np.ndarray, key: int) -> np.ndarray:
        low = np.uint64(0xFFFFFFFF)
        x = (x * np.uint64(FIRST) + np.uint64(key)) & low
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(SECOND)) & low
        return (x ^ (x >> np.uint64(13))) & np.uint64(self.mask)

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64(self.mask)
        if back:
            for key in reversed(self.keys):
                left, right = right ^ self._hash(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._hash(right, key)
        return left << np.uint64(self.half) | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(numbers, np.int64)
        if len(x) and not (0 <= x.min() and x.max() < self.n):
            raise ValueError(f"numbers must be in 0 to {self.n - 1}")
        x = self._network(x.astype(np.uint64), back)
        outside = np.flatnonzero(x >= self.n)
        while len(outside):
            x[outside] = self._network(x[outside], back)
            outside = outside[x[outside] >= self.n]
        return x.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def backward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, True)

    def place(self, numbers: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of the rows with these numbers."""
        permuted = self.forward(numbers)
        return permuted % shards, permuted // shards

    def number(self, shard: np.ndarray, slot: np.ndarray, shards: int = SHARDS) -> np.ndarray:
        """The numbers of the rows at these places."""
        return self.backward(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def _hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row, the second from another start."""
    plain = [
        F.to_json(F.struct(df[f"`{name}`"])) if "map<" in kind or "variant" in kind else df[f"`{name}`"]
        for name, kind in df.dtypes
    ]
    return [F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain)]


def _ordered_counts(counted: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``counted`` (one row for each distinct row, ``_n`` of them) with ``_from``, the number of its first; and all ``_n``."""
    ranged = durable(counted.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = durable(ranged.groupBy("_range").agg(F.sum("_n").alias("_rows")))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    # At most as many ranges as shuffle partitions.
    numbered = ranged.join(F.broadcast(before), "_range").withColumn("_from", first).drop("_range", "_before")
    return numbered, sizes.agg(F.sum("_rows")).first()[0] or 0


def numbered(df: DataFrame, key: str = "doc_id", at_once: int = AT_ONCE) -> tuple[DataFrame, int]:
    """``df`` with the global number of each row in ``row_number``; and how many rows there are.

    ``at_once`` moves work between tasks, never the result.
    """
    hashes = ["_h0", "_h1"]
    made = _hashes(df)
    row = df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"),
        df[f"`{key}`"].alias("_key"),
        *[h.alias(name) for h, name in zip(made, hashes, strict=True)],
    )
    counted = row.groupBy("_key", *hashes).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col("_key").asc_nulls_last(), *map(F.col, hashes)]
    firsts, n = _ordered_counts(counted, order)
    # Each distinct row once, at the task that its number comes to: the rows travel once.
    rows = row.select("_row", *hashes).dropDuplicates(hashes).join(firsts.select(*hashes, "_from", "_n"), hashes)
    last = F.col("_from") + F.col("_n") - 1
    few = rows.where(F.col("_n") <= at_once).select("_row", F.explode(F.sequence("_from", last)).alias("_number"))
    begins = F.explode(F.sequence("_from", last, F.lit(at_once)))
    many = (
        rows.where(F.col("_n") > at_once)
        .select("_row", last.alias("_last"), begins.alias("_from"))
        .repartition("_from")
        .select(
            "_row",
            F.explode(F.sequence("_from", F.least("_last", F.col("_from") + at_once - 1))).alias("_number"),
        )
    )
    every = few.unionByName(many)
    return every.select("_row.*", F.col("_number").alias(fresh_name(df, "row_number"))), n


def shard(
    df: DataFrame, shards: int = SHARDS, key: str = "doc_id", seed: int = SEED, at_once: int = AT_ONCE
) -> DataFrame:
    """``df`` with ``row_number`` (long), ``shard`` (int) and ``slot`` (long)."""
    rows, n = numbered(df, key, at_once)
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(numbers.to_numpy(np.int64)))

    number, held = fresh_name(df, "row_number"), fresh_name(df, "_permuted")
    shard_name, slot_name = fresh_name(df, "shard"), fresh_name(df, "slot")
    return (
        rows.withColumn(held, permuted(F.col(f"`{number}`")))
        .withColumn(shard_name, (F.col(f"`{held}`") % shards).cast("int"))
        .withColumn(slot_name, F.expr(f"`{held}` div {shards}"))
        .drop(held)
    )
