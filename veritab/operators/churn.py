"""Binary classification: split, boosted trees, evaluation, partial dependence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.numbers import round_half_even
from veritab.operators.boosting import SAMPLE_ROWS, Model, Tuned, dependence, tune
from veritab.operators.quantiles import group_quantiles, group_ranks

SPLITS = ("train", "validate", "test")
SHARES = (0.6, 0.2, 0.2)

# The grid of the boosted trees. An unlimited depth stands for 6, the
# customary depth of boosted trees left at their default.
GRID = {
    "maxDepth": [8, 6],
    "minChildWeight": [1, 5],
    "stepSize": [0.2, 0.3, 0.4],
    "maxIter": [50, 100],
}


def stratified_split(
    df: DataFrame, label: str, id_cols: Sequence[str], shares: Sequence[float] = SHARES, seed: int = 42
) -> DataFrame:
    """Add ``split``: each class cut at the given shares, in the order of a seeded hash.

    Of n rows of a class the first floor(q (n - 1)) + 1 lie below share q. The cuts are
    exact order statistics of the hash, so no class is sorted in one task.
    """
    hashed = df.withColumn(
        "_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in id_cols)), 11)
    )
    upto = [sum(shares[: i + 1]) for i in range(len(shares) - 1)]
    cuts = (
        group_ranks(hashed, [label], "_h", upto)
        .groupBy(label)
        .agg(*(F.max(F.when(F.col("q") == q, F.col("lower"))).alias(f"_c{i}") for i, q in enumerate(upto)))
    )
    chain = None
    for i, name in enumerate(SPLITS[: len(upto)]):
        test = F.col("_h") <= F.col(f"_c{i}")
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return hashed.join(cuts, label, "left").select(
        *df.columns, chain.otherwise(SPLITS[len(upto)]).alias("split")
    )


def tune_boosted_trees(
    train: DataFrame, features: Sequence[str], label: str, grid: dict[str, list] | None = None,
    folds: int = 5, seed: int = 42, sample_rows: int = SAMPLE_ROWS,
) -> Tuned:
    """Cross-validated grid search, refitted with the best recall of class 1; fitted on ``sample_rows`` rows at most."""
    return tune(train, features, label, grid or GRID, folds, seed, sample_rows)


def grid_results(tuned: Tuned, spark) -> DataFrame:
    """One row per parameter set with its mean recall, best first."""
    names = list(tuned.parameters[0])
    rows = [(*(p[n] for n in names), recall) for p, recall in zip(tuned.parameters, tuned.recalls)]
    schema = ", ".join(f"{n} double" for n in [*names, "recall"])
    return spark.createDataFrame(rows, schema).orderBy(F.col("recall").desc(), *names)


def confusion(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return (
        predicted.groupBy(
            F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def recall(predicted: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: hits, misses and recall of class 1, four places."""
    positive = F.col(label) == 1
    hit = F.count_if(positive & (F.col(prediction) == 1))
    miss = F.count_if(positive & (F.col(prediction) != 1))
    return predicted.agg(
        hit.alias("true_positives"),
        miss.alias("false_negatives"),
        round_half_even(F.try_divide(hit, hit + miss), 4).alias("recall"),
    )


def feature_importances(model: Model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), most important first."""
    rows = [(f, round(float(w), 4)) for f, w in zip(features, model.importances())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def partial_dependence(model: Model, df: DataFrame, features: Sequence[str], points: int = 10) -> DataFrame:
    """(feature, value, average_probability): mean prediction over all rows with one feature set to a value.

    The values are evenly spaced quantiles of the feature. All features and values are averaged in one pass.
    """
    quantiles = [i / (points - 1) for i in range(points)]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features))
    grid = {f: sorted({r["value"] for r in group_quantiles(rows, [], f, quantiles).collect()}) for f in features}
    return dependence(model, df, grid, df.sparkSession)
