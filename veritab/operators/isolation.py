"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) over numeric columns.

Trees grow on small hash-drawn samples, one task per tree, and are broadcast: their size is
bounded by trees times sample, whatever the table. Scoring passes over the table once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.numbers import parse_number
from veritab.operators.quantiles import group_quantiles
from veritab.session import durable

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.1, 42
FEWEST_ROWS, FEWEST_COLUMNS = 5, 2

_NODES = "tree int, node int, feature int, threshold double, child int, path double"


def separator_free(column: str):
    """A printed number without ',', '.' and blanks as double; 0 where it is none."""
    bare = F.regexp_replace(F.col(f"`{column}`").cast("string"), r"(?U)[,.\s]", "")
    return F.coalesce(parse_number(bare), F.lit(0.0))


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population standard deviation 1; constant columns are only centred."""
    stats = df.agg(
        F.struct(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns))
    ).scalar()
    with_stats = df.withColumn("_stats", stats)

    def scaled(c: str):
        s = F.col(f"_stats.{c}.s")
        return ((F.col(c) - F.col(f"_stats.{c}.m")) / F.when(s > 0, s).otherwise(1.0)).alias(c)

    return with_stats.select(*(scaled(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(columns: Sequence[str], limit: int, seed: int):
    def grow(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        values = pdf.sort_values("_u")[list(columns)].to_numpy()
        nodes = [[0, -1, 0.0, -1, 0.0]]
        open_nodes = [(0, np.arange(len(values)), 0)]
        while open_nodes:
            node, rows, depth = open_nodes.pop()
            part = values[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(splittable):
                nodes[node][4] = depth + mean_path(len(rows))
                continue
            feature = int(rng.choice(splittable))
            threshold = rng.uniform(low[feature], high[feature])
            left = part[:, feature] <= threshold
            child = len(nodes)
            nodes[node][1:4] = [feature, threshold, child]
            nodes += [[child, -1, 0.0, -1, 0.0], [child + 1, -1, 0.0, -1, 0.0]]
            open_nodes += [(child, rows[left], depth + 1), (child + 1, rows[~left], depth + 1)]
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "child", "path"])
        frame.insert(0, "tree", tree)
        return frame

    return grow


def _depth(child: np.ndarray, leaf: np.ndarray) -> int:
    """Steps from the root to the deepest leaf; children come after their parent."""
    depth = np.zeros(len(child), dtype="int64")
    for node in np.flatnonzero(~leaf):
        depth[child[node] : child[node] + 2] = depth[node] + 1
    return int(depth.max())


def _scorer(spark, nodes: pd.DataFrame, columns: Sequence[str], sample: int):
    trees = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        feature, threshold, child, path = (t[c].to_numpy() for c in ("feature", "threshold", "child", "path"))
        leaf = feature < 0
        # A leaf leads to itself, so that all rows take the same number of steps.
        child = np.where(leaf, np.arange(len(t)), child).astype("int64")
        trees.append((np.maximum(feature, 0).astype("int64"), np.where(leaf, np.inf, threshold), child, path, _depth(child, leaf)))
    packed = spark.sparkContext.broadcast(trees)
    usual = mean_path(sample) or 1.0

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        values = rows[list(columns)].to_numpy(dtype="float64")
        flat = np.ascontiguousarray(values).ravel()
        start = np.arange(len(values)) * values.shape[1]
        total = np.zeros(len(values))
        for feature, threshold, child, path, depth in packed.value:
            at = np.zeros(len(values), dtype="int64")
            for _ in range(depth):
                at = child[at] + (flat[start + feature[at]] > threshold[at])
            total += path[at]
        return pd.Series(-np.power(2.0, -total / len(packed.value) / usual))

    return score


def isolation_forest(
    df: DataFrame,
    id_cols: Sequence[str],
    columns: Sequence[str],
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """Add isolation (lower is stranger), anomaly_score (-1 or 1) and is_anomaly.

    ``id_cols`` tell rows apart; samples are drawn by their hash, so the same table gives the
    same forest. The rows below the exact quantile ``contamination`` are anomalies. With
    fewer than two columns or five rows nothing is.
    """
    spark = df.sparkSession
    columns = list(columns)
    names = [f"_x{i}" for i in range(len(columns))]
    numbers = df.select(
        F.struct("*").alias("_row"),
        F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in id_cols)).alias("_hash"),
        *(separator_free(c).alias(x) for c, x in zip(columns, names)),
    )
    moments = [f(x).alias(f"{x}_{k}") for x in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = numbers.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    n = stats["n"]
    if n < FEWEST_ROWS or len(columns) < FEWEST_COLUMNS:
        return df.select(
            "*", F.lit(None).cast("double").alias("isolation"), F.lit(1).alias("anomaly_score"), F.lit(False).alias("is_anomaly")
        )
    prepared = numbers.select(
        "_row", "_hash", *(((F.col(x) - stats[f"{x}_m"]) / (stats[f"{x}_s"] or 1.0)).alias(x) for x in names)
    )

    def uniform(hashed):
        return F.shiftrightunsigned(hashed, 11) / F.lit(float(2**53))

    size = min(sample, n)
    drawn = min(n, 2 * trees * sample)
    pool = prepared.filter(uniform(F.col("_hash")) < drawn / n).select("_hash", *names)
    each = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "*", uniform(F.xxhash64(F.lit(seed + 1), "_hash", "tree")).alias("_u")
    )
    nearest = Window.partitionBy("tree").orderBy("_u", "_hash")
    samples = (
        each.filter(F.col("_u") < min(1.0, 3.0 * size / drawn) if size < drawn else F.lit(True))
        .withColumn("_k", F.row_number().over(nearest))
        .filter(F.col("_k") <= size)
        .select("tree", "_u", *names)
    )
    limit = math.ceil(math.log2(max(size, 2)))
    nodes = samples.groupBy("tree").applyInPandas(_grow(names, limit, seed), _NODES).toPandas()
    score = _scorer(spark, nodes, names, size)
    scored = prepared.select("_row.*", score(F.struct(*names)).alias("isolation"))
    # Only the scores are written for the threshold; a score costs less to compute again than a row to copy.
    scores = durable(scored.select("isolation"))
    bound = group_quantiles(scores, [], "isolation", [contamination]).select("value").first()[0]
    strange = F.col("isolation") < F.lit(bound)
    return scored.select(
        "*", F.when(strange, -1).otherwise(1).alias("anomaly_score"), strange.alias("is_anomaly")
    )
