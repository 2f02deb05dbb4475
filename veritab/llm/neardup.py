"""Near-duplicate groups by SetSketch registers, exact on full shingle sets.

1. Sketch: each row's set of word shingles is hashed to 64 bits. A register keeps the smallest of the exponential
   hashes of the set, truncated to a grid of powers of BASE: such minima merge by maximum of the register and agree
   between two sets with a probability close to their Jaccard similarity. Rows with equal sets become one node.
2. Bands: groups of registers are hashed. Nodes that share a band's value are joined to one node of that
   bucket, never to each other; the components of these edges are clusters. Two sets at the threshold share a band
   with probability 1 - (1 - 0.85 ** 6) ** 32 = 1 - 3e-7 (other thresholds get bands of a length that misses no
   more than one in a million), unrelated ones hardly ever, so clusters stay small.
3. Verify: a cluster is dealt out in blocks of bounded size, each with the cluster's hub (the node with most bucket
   mates). In a block, pairs in different components are estimated jointly by the likelihood of their registers;
   those within reach of the threshold are compared on their full sets, and links merge components. So copies of one
   text are compared with their hub, not with each other. Only if a cluster has several blocks, nodes that did not
   join the hub's component meet the other blocks too, again in bounded groups.
4. Components of the verified links, by alternating stars, give each row its group.

No step emits the pairs of a group: a block returns at most one link per node. Nothing is capped or dropped: large
clusters only mean more blocks.

Defined cases: text without words, empty or null, has an empty set, is linked with nothing and kept. Fewer words
than a shingle has make one shingle. Null keys take part; a group's id is its smallest non-null key, null if it has
none. One row of a group is kept: the first by key (nulls last), digest of its set, hash of its text and row number,
so rows of other groups stay whatever key they share, and rows without a key go like others. Repeated rows fall in one
group; of rows without words, those with equal text under one key that isn't null are repeated rows, of which one is
kept. Only key and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name
from veritab.llm.components import components
from veritab.llm.vocabulary import bound_batches
from veritab.llm.worker import held
from veritab.session import durable

SHINGLE = 3
PERCENT = 85
REGISTERS = 192
#: Largest probability that two sets at the threshold share no band.
MISSED = 1e-6
#: SetSketch's base, rate and largest register.
BASE, RATE, LARGEST = 1.001, 20.0, 2**16 - 1
#: Nodes and shingles of one block, about.
BLOCK_NODES, BLOCK_SHINGLES = 1000, 4_000_000
#: Standard deviations that an estimate may lie below the threshold and still be verified.
MARGIN = 5.0
KEPT_WORDS = 200_000
#: Bytes of those words.
KEPT_BYTES = 8_000_000

_random = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _random.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 2**32, REGISTERS, dtype=np.uint32)
PLACES = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; most words come again."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.size += len(word)
        if len(self) >= KEPT_WORDS or self.size > KEPT_BYTES:
            self.clear()
            self.size = len(word)
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text. Bytes methods split and lower exactly the ASCII characters."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("word hashes", _Words).__getitem__, found), np.uint64, len(found))
    width = min(length, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total += _mixed(h[k : len(h) - width + 1 + k] * PLACES[k])
    return np.unique(_mixed(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for start in range(0, len(x), 128):
        part = x[start : start + 128, None] * FACTORS + SHIFTS
        np.minimum(least, part.min(0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def band_rows(percent: int) -> int:
    """The longest bands with which two sets at the threshold are missed with a probability of MISSED at most."""
    fit = [r for r in range(1, 33) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED]
    return max(fit, default=1)


def band_keys(r: np.ndarray, rows: int) -> np.ndarray:
    bands = REGISTERS // rows
    grouped = r[: bands * rows].reshape(bands, rows).astype(np.uint64)
    total = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        total = _mixed(total * PLACES[-1] + grouped[:, k] + np.uint64(1))
    return total.view(np.int64)


def estimate(r: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity of a set with each of ``others``, whose sizes are known.

    With u and v the shares of both sizes, the register of the first set is larger with probability u - vJ, smaller
    with v - uJ, equal with J; the derivative of the log-likelihood has one root in range, found by bisection.
    """
    u = n / (n + sizes)
    v = 1.0 - u
    equal = (others == r).sum(1)
    larger = (r > others).sum(1)
    smaller = REGISTERS - equal - larger
    low, high = np.zeros(len(sizes)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = equal / j - larger * v / (u - v * j) - smaller * u / (v - u * j)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.root[a], self.root[b]))
        self.root[self.root == high] = low


def link_block(
    sets: list[np.ndarray], first: np.ndarray, groups: np.ndarray, percent: int, order: np.ndarray
) -> _Forest:
    """Components of the links among ``sets``: each set with ``first`` meets all others, in ``order``.

    ``groups``: sets with an equal number are known to be connected.
    """
    forest = _Forest(len(sets))
    for g in np.unique(groups):
        forest.root[groups == g] = np.flatnonzero(groups == g)[0]
    sizes = np.array([len(s) for s in sets])
    sketch = np.stack([registers(s) for s in sets])
    t = percent / 100
    reach = t - MARGIN * (t * (1 - t) / REGISTERS) ** 0.5
    for i in order[first[order]]:
        apart = forest.root != forest.root[i]
        apart &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        at = np.flatnonzero(apart)
        if len(at):
            at = at[estimate(sketch[i], sizes[i], sketch[at], sizes[at]) >= reach]
        for j in at:
            if forest.root[i] != forest.root[j] and linked(sets[i], sets[j], percent):
                forest.join(i, j)
    return forest


def sketched(rows: DataFrame, length: int, percent: int) -> DataFrame:
    """(row, key, text_hash, n_shingles, d0, d1, bands) of each of ``rows``; d0, d1: digest of its set, null for an
    empty one."""
    bound_batches(rows.sparkSession)
    band = band_rows(percent)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch:
                s = shingles(t, length)
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    found.append((len(s), int(d[0]), int(d[1]), band_keys(registers(s), band)))
                else:
                    found.append((0, None, None, None))
            sizes, d0, d1, bands = (list(c) for c in zip(*found)) if found else ([], [], [], [])
            digests = {"d0": pd.array(d0, "Int64"), "d1": pd.array(d1, "Int64")}  # a float would round them
            yield pd.DataFrame({"n_shingles": sizes, **digests, "bands": bands})

    sketch = F.pandas_udf(of, "n_shingles long, d0 long, d1 long, bands array<long>")
    hashed = rows.select("row", "key", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s"))
    return hashed.select("row", "key", "text_hash", "s.*")


def _clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster, hub, blocks) of the nodes that share a band with another one."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("mates")).where("mates > 1")
    shared = durable(banded.join(buckets, "band").select("node", "centre", "mates"))
    cluster = components(shared.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    degree = shared.groupBy("node").agg(F.sum("mates").alias("degree"))
    members = (
        cluster.join(degree, "node")
        .join(nodes.select("node", "n_shingles"), "node")
        .select("node", F.col("root").alias("cluster"), "degree", "n_shingles")
    )
    sizes = members.groupBy("cluster").agg(
        F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"),
        F.ceil(
            F.greatest(F.count("*") / BLOCK_NODES, F.sum("n_shingles") / BLOCK_SHINGLES)
        ).cast("int").alias("blocks"),
    )
    return durable(members.join(sizes, "cluster").select("node", "cluster", "hub", "blocks"))


def groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of ``df``; one row of each component is kept."""
    texts = durable(df.select(F.monotonically_increasing_id().alias("row"), df[key].alias("key"), df[text].alias("text")))
    return _judged(texts, length, percent).drop("row")


def _judged(texts: DataFrame, length: int, percent: int) -> DataFrame:
    """(row, key, n_shingles, component_id, kept) of each of ``texts`` (row, key, text), a table with distinct ``row``."""
    rows = durable(sketched(texts, length, percent))
    whole = rows.where("n_shingles > 0")
    order = F.struct(F.col("key").isNull().alias("nameless"), "key", "d0", "d1", "text_hash", "row")
    nodes = durable(
        whole.groupBy("d0", "d1")
        .agg(F.min(order).alias("best"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .select("*", F.col("best.row").alias("row"), F.monotonically_increasing_id().alias("node"))
    )
    placed = _clusters(nodes)
    found = _links(texts, length, percent, nodes, placed)
    joined = components(found)
    best = nodes.select("node", "best")
    by_root = joined.join(best, "node").groupBy("root").agg(F.min("best").alias("first"))
    named = joined.join(by_root, "root").select("node", "first")
    of_set = nodes.join(named, "node", "left").select("d0", "d1", F.coalesce("first", "best").alias("first"))
    full = whole.join(of_set, ["d0", "d1"]).select(
        "row",
        "key",
        "n_shingles",
        F.col("first.key").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
    empty = rows.where("n_shingles = 0")
    once = empty.where("key IS NOT NULL").groupBy("key", "text_hash").agg(F.min("row").alias("row"))
    alone = empty.join(once.select("row", F.lit(True).alias("first")), "row", "left").select(
        "row",
        "key",
        "n_shingles",
        F.col("key").alias("component_id"),
        (F.col("key").isNull() | F.coalesce("first", F.lit(False))).alias("kept"),
    )
    return full.union(alone)


def _with_text(texts: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """The nodes of ``placed``, each with one text of its set.

    Texts are fetched by the number of one row, not by key, so a key of many rows multiplies nothing.
    """
    return (
        placed.join(nodes.select("node", "row"), "node")
        .join(texts.select("row", "text"), "row")
        .select("node", "cluster", "hub", "blocks", "text")
        .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    )


def _links(texts: DataFrame, length: int, percent: int, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect what links connect."""
    with_text = _with_text(texts, nodes, placed)

    def sets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [shingles(t, length) for t in pdf["text"]]

    def within(ids: tuple, fit: pd.DataFrame) -> pd.DataFrame:
        sets = sets_of(fit)
        at_hub = (fit["node"] == fit["hub"]).to_numpy()
        order = np.concatenate([np.flatnonzero(at_hub), np.flatnonzero(~at_hub)])
        everything = np.arange(len(fit))
        forest = link_block(sets, np.ones(len(fit), bool), everything, percent, order)
        node = fit["node"].to_numpy()
        names = {r: node[np.flatnonzero(forest.root == r)].min() for r in np.unique(forest.root)}
        if at_hub.any():
            names[forest.root[np.flatnonzero(at_hub)[0]]] = fit["hub"].iloc[0]
        return pd.DataFrame(
            {"cluster": ids[0], "block": ids[1], "node": node, "root": [names[r] for r in forest.root]}
        )

    everywhere = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array("block")
    )
    local = durable(
        with_text.withColumn("block", F.explode(everywhere))
        .groupBy("cluster", "block")
        .applyInPandas(within, "cluster long, block int, node long, root long")
    )

    # Clusters of several blocks: what the hub did not reach meets all other blocks, in groups of bounded size.
    split = local.join(placed.where("blocks > 1").select("node", "hub", "blocks"), "node").dropDuplicates(["node"])
    left = split.where(F.col("root") != F.col("hub"))
    parts = left.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("parts"))
    asked = left.join(parts, "cluster").select(
        "node",
        "root",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"),
        F.pmod(F.hash(F.col("node") + 1), F.col("parts")).alias("part"),
        F.lit(True).alias("other"),
    )
    there = split.join(parts, "cluster").select(
        "node",
        "root",
        F.col("block").alias("to_block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("other"),
    )

    def across(fit: pd.DataFrame) -> pd.DataFrame:
        sets = sets_of(fit)
        forest = link_block(
            sets, fit["other"].to_numpy(), fit["root"].to_numpy(), percent, np.arange(len(fit))
        )
        node = fit["node"].to_numpy()
        return pd.DataFrame({"a": node, "b": node[forest.root]})

    meeting = asked.union(there).join(with_text.drop("block"), "node")
    more = meeting.groupBy("cluster", "to_block", "part").applyInPandas(across, "a long, b long")
    return local.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)


def deduplicate(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row of ``df`` for each group, chosen by row, not by key."""
    row = fresh_name(df, "_row")
    rows = durable(df.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), rows[key].alias("key"), rows[text].alias("text"))
    kept = _judged(texts, length, percent).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
