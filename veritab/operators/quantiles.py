"""Exact order statistics of groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one task. Here the range that holds a wanted
rank is narrowed by counting: the range is cut into CELLS cells, the values in each are counted with partial
sums, and the cell that holds the rank becomes the new range, from its least to its largest value. Counts are exact,
so a range never misses its rank. Once a range holds LAST values at most, they are sorted. A group of any size goes
the same way; no task sees more than CELLS counts or LAST values of a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.session import durable

CELLS = 4096
LAST = 4096
_LARGEST = 1.7976931348623157e308


def _magnitude(v: Column) -> Column:
    """Grows with ``v``, by its logarithm on either side of zero; 750 puts the least double above it."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 750))


def _cell(value: str, kind: T.DataType, cells: int) -> Column:
    """The cell of a value between ``lo`` and ``hi``; never smaller for a larger value.

    Cells are equal in magnitude where the range spans more than a factor of two, else in width, so a few rounds
    narrow any distribution.
    """
    v, lo, hi = (
        F.least(F.greatest(F.col(c).cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST)) for c in (value, "lo", "hi")
    )
    spans = ((lo <= 0) & (hi >= 0)) | ((lo > 0) & (hi / 2 > lo)) | ((hi < 0) & (lo / 2 < hi))
    by_magnitude = (_magnitude(v) - _magnitude(lo)) / (_magnitude(hi) - _magnitude(lo))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        by_width = (v - lo) / (hi - lo)
    else:  # differences of whole numbers and decimals are exact
        digits = kind if isinstance(kind, T.DecimalType) else T.DecimalType(20, 0)
        x, low, high = (F.col(c).cast(digits) for c in (value, "lo", "hi"))
        by_width = (x - low).cast("double") / (high - low).cast("double")
    part = F.when(spans, by_magnitude).otherwise(by_width)
    return F.least(F.greatest(F.floor(part * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def select_ranks(
    values: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], cells: int = CELLS, last: int = LAST
) -> DataFrame:
    """(keys, q, n, lower, upper): the values at ranks floor and ceil of q (n - 1) of each group.

    ``value`` holds no NaN; groups whose values are all null have n = 0 and no values.
    """
    keys, kind = list(keys), values.schema[value].dataType
    present = values.select(*keys, F.col(value).alias("_v"))
    groups = durable(
        present.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    )
    wanted = groups.filter("n > 0").select(
        *keys, "n", "lo", "hi",
        F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q"),
    )
    position = F.col("q") * (F.col("n") - 1)
    ranks = wanted.select(
        *keys, "n", "q", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))).alias("rank"),
        "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"),
    )
    open_ = (F.col("inside") > last) & (F.col("lo") < F.col("hi"))
    on = [*keys, "lo", "hi", "below"]
    upto = Window.partitionBy(*on).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = durable(ranks)
    while not ranks.filter(open_).isEmpty():
        ranges = ranks.filter(open_).select(*on).distinct()
        held = _held(present, ranges, keys)
        counted = (
            held.groupBy(*on, _cell("_v", kind, cells).alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            .withColumn("_cum", F.sum("_c").over(upto))
        )
        found = (
            ranks.filter(open_).join(counted, on)
            .filter((F.col("below") + F.col("_cum") > F.col("rank")) & (F.col("below") + F.col("_cum") - F.col("_c") <= F.col("rank")))
            .select(
                *keys, "n", "q", "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                (F.col("below") + F.col("_cum") - F.col("_c")).alias("below"), F.col("_c").alias("inside"),
            )
        )
        ranks = durable(ranks.filter(~open_).unionByName(found))
    single = F.col("lo") == F.col("hi")
    several = ranks.filter(~single)
    sorted_ = (
        _held(present, several.select(*on).distinct(), keys)
        .groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cum", F.sum("_c").over(Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    at = (F.col("below") + F.col("_cum") > F.col("rank")) & (F.col("below") + F.col("_cum") - F.col("_c") <= F.col("rank"))
    picked = several.join(sorted_, on).filter(at).select(*keys, "n", "q", "rank", F.col("_v").alias("v")).unionByName(
        ranks.filter(single).select(*keys, "n", "q", "rank", F.col("lo").alias("v"))
    )
    return picked.groupBy(*keys, "q", "n").agg(F.min("v").alias("lower"), F.max("v").alias("upper"))


def _held(present: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each range of their group that holds them. Ranges of a group: two for each quantile at most."""
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    if keys:
        return present.join(ranges, keys).filter(inside)
    return present.join(F.broadcast(ranges), inside)


def interpolated(result: DataFrame, name: str = "value") -> DataFrame:
    """Linear interpolation between the two ranks."""
    position = F.col("q") * (F.col("n") - 1)
    part = position - F.floor(position)
    lower, upper = F.col("lower").cast("double"), F.col("upper").cast("double")
    return result.withColumn(name, lower + (upper - lower) * part).drop("lower", "upper")


def group_ranks(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], empty_groups: bool = False
) -> DataFrame:
    """``select_ranks`` of one value column by ``keys``; nulls and NaN are left out.

    ``empty_groups`` adds a row of nulls for each group and quantile without a value.
    """
    keys = list(keys)
    v = F.col(f"`{value}`")
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(v), v)
    values = df.select(*keys, v.alias("_value"))
    found = select_ranks(values, keys, "_value", quantiles)
    if not empty_groups:
        return found
    empty = values.groupBy(*keys).agg(F.count("_value").alias("n")).filter("n = 0")
    rows = empty.select(*keys, F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q"), "n")
    return found.unionByName(rows, allowMissingColumns=True)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], empty_groups: bool = False
) -> DataFrame:
    """(keys, q, n, value) with linear interpolation."""
    return interpolated(group_ranks(df, keys, value, quantiles, empty_groups))
