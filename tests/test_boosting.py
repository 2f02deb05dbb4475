"""Boosted trees on bins, against the defining formulas and Spark's own trees."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veritab.operators import boosting, churn


def brute_root(binned, labels, bins, least):
    """Gain, feature and cut of the best first split."""
    g, h = 0.5 - labels, np.full(len(labels), 0.25)
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
    found = []
    for f in range(binned.shape[1]):
        for b in range(bins):
            left = binned[:, f] <= b
            if h[left].sum() >= least and h[~left].sum() >= least:
                found.append((score(left) + score(~left) - score(left | True), -f, -b))
    gain, f, b = max(found)
    return gain, -f, -b


@pytest.mark.parametrize("least", [1.0, 5.0])
def test_first_split_and_leaves(least):
    rng = np.random.default_rng(4)
    binned = rng.integers(0, 12, (300, 4))
    labels = ((binned[:, 2] > 7) ^ (rng.random(300) < 0.2)).astype(float)
    grown = boosting.grow(binned, labels, 12, 3, least, 0.3, 2)
    gain, feature, cut = brute_root(binned, labels, 12, least)
    assert (grown.feature[0, 0], grown.cut[0, 0]) == (feature, cut)
    left = binned[:, feature] <= cut
    one = boosting.grow(binned, labels, 12, 1, least, 0.3, 1)
    assert one.gain[0, feature] == pytest.approx(gain)
    for rows, node in ((left, 1), (~left, 2)):
        g, h = (0.5 - labels[rows]).sum(), 0.25 * rows.sum()
        assert one.leaf[0, node] == pytest.approx(-0.3 * g / (h + 1))
        assert np.allclose(one.margins(binned)[rows], one.leaf[0, node])


def test_no_child_is_lighter_than_asked():
    rng = np.random.default_rng(5)
    binned, labels = rng.integers(0, 9, (120, 3)), rng.integers(0, 2, 120).astype(float)
    trees = boosting.grow(binned, labels, 9, 6, 5.0, 0.3, 1)
    node = np.zeros(120, int)
    for _ in range(6):
        at = trees.feature[0, node]
        node = np.where(at >= 0, 2 * node + 1 + (binned[np.arange(120), np.maximum(at, 0)] > trees.cut[0, node]), node)
    assert all(0.25 * n >= 5.0 for n in np.bincount(node) if n) and trees.feature[0, 0] >= 0


def test_fewer_trees_are_the_beginning_of_more():
    rng = np.random.default_rng(6)
    binned, labels = rng.integers(0, 9, (200, 3)), rng.integers(0, 2, 200).astype(float)
    more, fewer = (boosting.grow(binned, labels, 9, 3, 1.0, 0.3, k) for k in (12, 5))
    assert np.allclose(more.margins(binned, 5), fewer.margins(binned))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).selectExpr(
        "id", "rand(1) as x", "case when id % 9 = 0 then null else rand(2) end as z", "rand(3) as noise"
    ).withColumn("y", F.expr("cast(x + coalesce(z, 1.5) + 0.05 * randn(4) > 1.2 as int)")).cache()


def test_recall_is_near_that_of_sparks_trees(spark, rows):
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    names = ["x", "z", "noise"]
    tuned = churn.tune_boosted_trees(train, names, "y", {"maxDepth": [4], "maxIter": [20], "stepSize": [0.3]}, folds=3)
    ours = churn.recall(tuned.bestModel.transform(test), "y").first().recall
    filled = lambda df: VectorAssembler(inputCols=names, outputCol="v").transform(df.fillna(-1.0, ["z"]))
    trees = GBTClassifier(featuresCol="v", labelCol="y", maxDepth=4, maxIter=20, stepSize=0.3, seed=1).fit(filled(train))
    assert abs(float(ours) - float(churn.recall(trees.transform(filled(test)), "y").first().recall)) < 0.02
    assert abs(tuned.recalls[0] - float(ours)) < 0.05
    best = churn.feature_importances(tuned.bestModel, names, spark).collect()
    assert sum(r.importance for r in best) == pytest.approx(1, abs=1e-3) and best[-1].feature == "noise"


def test_dependence_is_the_average_over_all_rows(spark, rows):
    model = churn.tune_boosted_trees(rows, ["x", "z"], "y", {"maxDepth": [3], "maxIter": [5]}, folds=2).bestModel
    curve = churn.partial_dependence(model, rows, ["x", "z"], 4).collect()
    assert {r.feature for r in curve} == {"x", "z"} and len(curve) == 8
    for r in curve:
        moved = model.transform(rows.withColumn(r.feature, F.lit(r.value)))
        assert r.average_probability == pytest.approx(moved.agg(F.avg("probability")).first()[0])


def test_sample_is_bounded_and_the_grid_is_whole(spark, rows):
    tuned = churn.tune_boosted_trees(
        rows, ["x"], "y", {"maxDepth": [1, 2], "minChildWeight": [1, 5], "maxIter": [2, 3]}, folds=2, sample_rows=500
    )
    table = churn.grid_results(tuned, spark).collect()
    assert len({(r.maxDepth, r.minChildWeight, r.maxIter) for r in table}) == 8
    assert len(boosting._sample(rows, ["x"], "y", 500, 42)) <= 500
    assert table[0].recall == max(tuned.recalls)
