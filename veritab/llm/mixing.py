"""Mixing sources to target weights.

Words are counted per document once, summed per source with partial sums before the shuffle, and turned into a
target per source. Weights are given by rank (sources in code point order, the null source last, the list of
weights repeating). The targets share ``total`` times all words by weight, but none goes over ``most`` times its
source's size; what is cut off is shared again by weight. That fill has a closed form: with the sources sorted by
cap over weight and C, W the caps before and the weights from a source on, the level is the largest
(total - C) / W, and each target is min(cap, weight * level). So one sorted running sum over the sources replaces
the repeated sharing.

A document of a source with rate r = target / size is emitted floor(r) times, plus once more with probability
r - floor(r), decided by a hash of seed and key alone: reruns, other partitionings and lost executors agree.

Defined cases: null text has size 0; the null source is a source of its own; a source of size 0 has target 0 and
rate 0, so its documents are not emitted; a null key hashes as the empty text; repeated rows draw the same number
and are each emitted as often; an empty table gives no rows. Columns of the input are kept in ``mix``; added names
get underscores where they clash.

Rows per source may be very uneven: only (key, source, size) travels, and the join with the per-source table is
left to Spark, which broadcasts it if it is measured to be small and splits hot keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name, words
from veritab.session import durable

WEIGHTS = (5.0, 2.0, 1.0)
#: Words to take, as a multiple of all words there are.
TOTAL = 1.5
#: Most words to take of a source, as a multiple of its size.
MOST = 2.0
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST
) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size). The windows hold one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    everything = Window.partitionBy()
    level = (total * F.sum("source_size").over(everything) - F.col("cap_before")) / F.col("weight_left")
    filled = (
        capped.withColumn("cap_before", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything)))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return filled.select("source", "source_size", "target", rate.alias("rate"))


def allocate(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of ``df``: key, source, size, source_size, target, rate and copies to emit."""
    sizes = durable(df.select(df[key].alias("key"), df[source].alias("source"), size_of(df[text]).alias("size")))
    targets = source_targets(sizes, weights, total, most).withColumnRenamed("source", "of")
    whole = F.floor("rate")
    extra = F.when(draw(F.col("key"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("copies", (whole + extra).cast("long"))
    )


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Rows of ``df``, each as often as the mix takes it. The rate is joined on, so whole texts aren't shuffled."""
    sizes = df.select(df[source].alias("source"), size_of(df[text]).alias("size"))
    rates = durable(source_targets(sizes, weights, total, most).select(F.col("source").alias("_of"), "rate"))
    rate, copy = fresh_name(df, "_rate"), fresh_name(df, "_copy")
    of = fresh_name(df, "_of")
    rates = rates.withColumnRenamed("_of", of).withColumnRenamed("rate", rate)
    whole = F.floor(F.col(rate))
    extra = F.when(draw(F.col(key), seed) < F.col(rate) - whole, 1).otherwise(0)
    joined = df.join(rates, df[source].eqNullSafe(rates[of])).withColumn(copy, (whole + extra).cast("int"))
    return (
        joined.where(F.col(copy) > 0)
        .withColumn(copy, F.explode_outer(F.sequence(F.lit(1), F.col(copy))))
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )
