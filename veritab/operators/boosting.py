"""Second-order boosted trees on shared quantile bins, and a whole parameter grid fitted side by side.

Features are cut once into at most BINS quantile bins over all training rows; a value that is missing has a bin of its
own below the others. Trees are grown level by level from histograms of gradients and hessians, so ``minChildWeight``
is a sum of hessians. The fits of a grid are independent: each task takes one parameter set and fold. What they are
fitted on is a bounded sample, so that every fit has it as bytes: ``sample_rows`` training rows at most, drawn by a seed
if there are more. Bins, predictions, recalls and dependences cover all rows.

A model of fewer trees is the beginning of one of more, so sets that differ in ``maxIter`` alone share a fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 64
#: Training rows that the trees are fitted on at most.
SAMPLE_ROWS = 50_000
#: Weight of the squares of the leaves.
LAMBDA = 1.0
#: Defaults of parameters that a grid may leave out.
DEFAULTS = {"maxDepth": 6, "minChildWeight": 1.0, "stepSize": 0.3, "maxIter": 100}


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node k has the children 2 k + 1 and 2 k + 2.

    feature: by tree and node, -1 for a leaf; cut: rows with this bin or a lower one go left; leaf: the margin added.
    gain: total gain by feature, of each tree.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    def margins(self, binned: np.ndarray, upto: int | None = None) -> np.ndarray:
        total = np.zeros(len(binned))
        rows = np.arange(len(binned))
        for feature, cut, leaf in zip(self.feature[:upto], self.cut[:upto], self.leaf[:upto]):
            node = np.zeros(len(binned), np.int64)
            while True:
                at = feature[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = binned[rows, np.maximum(at, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += leaf[node]
        return total


def grow(
    binned: np.ndarray, labels: np.ndarray, bins: int, depth: int, min_child_weight: float, step: float, trees: int
) -> Trees:
    """Boosted trees for labels 0 and 1 from a matrix of bins below ``bins``."""
    n, width = binned.shape
    nodes = 2 ** (depth + 1) - 1
    feature, cut = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32)
    leaf, gains = np.zeros((trees, nodes)), np.zeros((trees, width))
    offset = np.arange(width) * bins + binned
    margin = np.zeros(n)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - labels, p * (1.0 - p)
        node = np.zeros(n, np.int64)
        active = np.arange(n)
        for level in range(depth + 1):
            first, count = 2**level - 1, 2**level
            if not len(active):
                break
            local = node[active] - first
            sums = [np.bincount(local, x[active], count) for x in (g, h)]
            leaf[t, first : first + count] = -step * sums[0] / (sums[1] + LAMBDA)
            if level == depth:
                break
            cell = (local[:, None] * (width * bins) + offset[active]).ravel()
            gl, hl = (
                np.bincount(cell, np.repeat(x[active], width), count * width * bins).reshape(count, width, bins).cumsum(2)
                for x in (g, h)
            )
            g_all, h_all = sums[0][:, None, None], sums[1][:, None, None]
            gr, hr = g_all - gl, h_all - hl
            gain = gl**2 / (hl + LAMBDA) + gr**2 / (hr + LAMBDA) - g_all**2 / (h_all + LAMBDA)
            gain[(hl < min_child_weight) | (hr < min_child_weight)] = 0.0
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            most = flat[np.arange(count), best]
            split = most > 1e-9
            feature[t, first : first + count] = np.where(split, best // bins, -1)
            cut[t, first : first + count] = best % bins
            np.add.at(gains[t], best[split] // bins, most[split])
            active = active[split[local]]
            at = node[active]
            node[active] = 2 * at + 1 + (binned[active, feature[t, at]] > cut[t, at])
        margin += leaf[t, node]
    return Trees(feature, cut, leaf, gains)


@dataclass(frozen=True)
class Model:
    """Fitted trees with the features and the upper ends of their bins."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    trees: Trees

    def binned(self, values: np.ndarray) -> np.ndarray:
        columns = [1 + np.searchsorted(e, values[:, k]) for k, e in enumerate(self.edges)]
        out = np.stack(columns, axis=1) if columns else np.zeros((len(values), 0), np.int64)
        out[np.isnan(values)] = 0
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.trees.margins(self.binned(values))))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` of class 1 and ``prediction`` (double)."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(values: pd.DataFrame) -> pd.Series:
            return pd.Series(model.value.probabilities(values.to_numpy(float)))

        inputs = F.struct(*[F.col(f"`{c}`").cast("double").alias(c) for c in self.features])
        scored = df.withColumn("probability", probability(inputs))
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        total = self.trees.gain.sum(0)
        return total / total.sum() if total.sum() > 0 else total


@dataclass(frozen=True)
class Tuned:
    """parameters and their mean recall over the folds, in the order of the grid; the model of the best set."""

    parameters: list[dict[str, float]]
    recalls: list[float]
    bestModel: Model


def _edges(train: DataFrame, features: Sequence[str], bins: int) -> tuple[np.ndarray, ...]:
    """Ends of quantile bins, from a mergeable sketch over all rows: bins - 2 numbers a feature."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return tuple(np.unique(np.array(e, float)) for e in found.approxQuantile(list(features), shares, 0.25 / bins))


def _sample(train: DataFrame, features: Sequence[str], label: str, rows: int, seed: int) -> pd.DataFrame:
    """All rows in the order of their values, or a seeded sample of ``rows`` at most."""
    values = [F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)]
    picked = train.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), *values)
    n = picked.count()
    if n > rows:
        picked = picked.sample(fraction=0.98 * rows / n, seed=seed).limit(rows)
    found = picked.toPandas()
    return found.sort_values(list(found.columns), ignore_index=True)


def tune(
    train: DataFrame, features: Sequence[str], label: str, grid: dict[str, list], folds: int = 5, seed: int = 42,
    sample_rows: int = SAMPLE_ROWS, bins: int = BINS,
) -> Tuned:
    """The grid's sets compared by the mean recall of class 1 over the folds; the best, first among equals, is refitted."""
    spark = train.sparkSession
    sample = _sample(train, features, label, sample_rows, seed)
    edges = _edges(train, features, bins)
    empty = Trees(*(np.zeros((0, 0)) for _ in range(4)))
    binned = Model(tuple(features), edges, empty).binned(sample.drop(columns="y").to_numpy(float)).astype(np.uint8)
    labels = sample["y"].to_numpy(np.int8)
    fold = np.random.Generator(np.random.PCG64(seed)).permutation(len(labels)) % folds
    shared = spark.sparkContext.broadcast((binned, labels, fold))
    sets = [DEFAULTS | dict(zip(grid, values)) for values in product(*grid.values())]
    grown = sorted({(s["maxDepth"], s["minChildWeight"], s["stepSize"]) for s in sets})
    sizes = sorted({s["maxIter"] for s in sets})

    def fit(key: tuple, rows: np.ndarray, trees: int) -> Trees:
        binned, labels, _ = shared.value
        depth, weight, step = key
        return grow(binned[rows].astype(np.int64), labels[rows].astype(float), bins, int(depth), weight, step, int(trees))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        binned, labels, fold = shared.value
        for batch in batches:
            for job in batch.itertuples():
                trees = fit(grown[job.place], fold != job.fold, sizes[-1])
                held = (fold == job.fold) & (labels == 1)
                yield pd.DataFrame(
                    [
                        (job.place, job.fold, size, float((trees.margins(binned[held], size) > 0).mean()) if held.any() else 0.0)
                        for size in sizes
                    ],
                    columns=["place", "fold", "size", "recall"],
                )

    jobs = [(place, k) for place in range(len(grown)) for k in range(folds)]
    tasks = spark.createDataFrame(jobs, "place int, fold int").repartition(len(jobs))
    compared = tasks.mapInPandas(compare, "place int, fold int, size int, recall double").toPandas()
    mean = compared.groupby(["place", "size"])["recall"].mean()
    recalls = [
        float(mean[grown.index((s["maxDepth"], s["minChildWeight"], s["stepSize"])), s["maxIter"]]) for s in sets
    ]
    best = sets[int(np.argmax(recalls))]
    trees = fit((best["maxDepth"], best["minChildWeight"], best["stepSize"]), np.ones(len(labels), bool), best["maxIter"])
    asked = [{k: float(s[k]) for k in grid} for s in sets]
    return Tuned(asked, recalls, Model(tuple(features), edges, trees))


def dependence(model: Model, df: DataFrame, grid: dict[str, list[float]], spark: SparkSession) -> DataFrame:
    """(feature, value, average_probability) for the given values of some features, in one pass over the rows.

    A task adds up its rows' probabilities for every feature set to every value; only these sums are shuffled.
    """
    shared = spark.sparkContext.broadcast((model, grid))
    points = [(f, float(v)) for f, values in grid.items() for v in values]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, _ = shared.value
        total, n = np.zeros(len(points)), 0
        for batch in batches:
            values = batch.to_numpy(float)
            n += len(values)
            for k, (feature, value) in enumerate(points):
                at = model.features.index(feature)
                kept = values[:, at].copy()
                values[:, at] = value
                total[k] += model.probabilities(values).sum()
                values[:, at] = kept
        if n:
            yield pd.DataFrame(
                {"feature": [f for f, _ in points], "value": [v for _, v in points], "total": total, "n": n}
            )

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in model.features])
    sums = rows.mapInPandas(add, "feature string, value double, total double, n long")
    return sums.groupBy("feature", "value").agg((F.sum("total") / F.sum("n")).alias("average_probability"))
