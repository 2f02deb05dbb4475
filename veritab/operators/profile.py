"""Profiles, group summaries and top records of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.numbers import parse_number, round_half_even
from veritab.operators import quantiles as Q
from veritab.operators.clean import numeric_columns, text_columns

STATISTICS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
_QUARTILES = [0.25, 0.5, 0.75]


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _present(df: DataFrame, column: str) -> Column:
    """The column with NaN as null: a missing value, as in every statistic here."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def describe(df: DataFrame) -> DataFrame:
    """Eight statistics (rows) of every numeric column, rounded to two places.

    Moments come from one aggregate, the quartiles from narrowing ranges by counting.
    Without numeric columns the result is empty.
    """
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "statistic string")
    nums = df.select(
        *(_present(df, c).cast("double").alias(f"_{i}") for i, c in enumerate(names))
    )
    ids = range(len(names))
    wide = nums.agg(
        *(
            F.struct(
                F.lit(i).alias("col"),
                F.count(f"_{i}").alias("n"),
                F.avg(f"_{i}").alias("mean"),
                F.stddev_samp(f"_{i}").alias("std"),
                F.min(f"_{i}").alias("low"),
                F.max(f"_{i}").alias("high"),
            ).alias(f"_{i}")
            for i in ids
        )
    )
    per_column = wide.select(F.inline(F.array(*(F.col(f"_{i}") for i in ids))))
    values = nums.select(
        F.inline(
            F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"_{i}").alias("_value")) for i in ids))
        )
    ).filter(F.col("_value").isNotNull())
    ranks = Q.interpolated(Q.select_ranks(values, ["col"], "_value", _QUARTILES), "_value")
    quartile = ranks.select(
        "col",
        (F.lit(4) + F.array_position(F.array(*(F.lit(q) for q in _QUARTILES)), F.col("q")).cast("int") - 1).alias("pos"),
        "_value",
    )
    moments = per_column.select(
        "col",
        F.posexplode(F.array(F.col("n").cast("double"), "mean", "std", "low")).alias("pos", "_value"),
    ).unionByName(per_column.select("col", F.lit(7).alias("pos"), F.col("high").alias("_value")))
    table = moments.unionByName(quartile).groupBy("pos").pivot("col", list(ids)).agg(F.first("_value"))
    label = F.array(*(F.lit(s) for s in STATISTICS))
    return table.orderBy("pos").select(
        F.get(label, F.col("pos")).alias("statistic"),
        *(round_half_even(f"`{i}`", 2).alias(c) for i, c in enumerate(names)),
    )


def _long_values(df: DataFrame) -> DataFrame:
    """(pos, value) pairs of all columns, as text; -0.0 counts as 0.0."""

    def cell(i: int, c: str) -> Column:
        value = _present(df, c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            value = value + 0.0
        return F.struct(F.lit(i).alias("pos"), value.cast("string").alias("value"))

    return df.select(F.inline(F.array(*(cell(i, c) for i, c in enumerate(df.columns)))))


def column_info(df: DataFrame, relative_error: float | None = None) -> DataFrame:
    """Name, type, non-null, null and distinct count of every column.

    One grouping by (column, value) serves all columns: repeated values meet before the
    shuffle, and no column's values pass through one task. With ``relative_error`` the
    distinct counts are estimates and nothing but one sketch a column is shuffled.
    """
    if relative_error is not None:
        return _estimated_info(df, relative_error)
    counted = _long_values(df).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("_c"))
    stats = counted.groupBy("pos").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("_c")).otherwise(0)).alias("non_null"),
        F.sum(F.when(F.col("value").isNull(), F.col("_c")).otherwise(0)).alias("null"),
        F.count("value").alias("unique"),
    )
    names = F.array(*(F.lit(c) for c in df.columns))
    types = F.array(*(F.lit(f.dataType.simpleString()) for f in df.schema.fields))
    return stats.orderBy("pos").select(
        F.get(names, F.col("pos")).alias("column"),
        F.get(types, F.col("pos")).alias("type"),
        "non_null",
        "null",
        "unique",
    )


def _estimated_info(df: DataFrame, relative_error: float) -> DataFrame:
    def facts(c: str) -> Column:
        n = F.count(_present(df, c))
        return F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            n.alias("non_null"), (F.count(F.lit(1)) - n).alias("null"),
            F.approx_count_distinct(_present(df, c), relative_error).alias("unique"),
        )

    return df.agg(F.array(*(facts(c) for c in df.columns)).alias("all")).select(F.inline("all"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column."""
    wide = df.agg(*(F.count_if(_missing(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)))
    return wide.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls"))
                    for i, c in enumerate(df.columns)
                )
            )
        )
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric and text columns, nulls in all."""
    nulls = sum((F.count_if(_missing(df, c)) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("text_columns"),
        nulls.alias("total_nulls"),
    )


def non_numeric_count(df: DataFrame, column: str) -> DataFrame:
    """One row: values of a column that are no numbers, nulls included."""
    bad = parse_number(f"`{column}`").isNull()
    return df.agg(F.count_if(bad).alias("non_numeric"))


def value_counts_of(df: DataFrame, marks: dict[str, str]) -> DataFrame:
    """One row: how often each column equals its marker."""
    return df.agg(*(F.count_if(F.col(f"`{c}`") == v).alias(f"{c}_is_{v}") for c, v in marks.items()))


def _simple_aggregate(func: str, c: Column, order: Column | None) -> Column | None:
    n = F.count(c)
    if func == "mean":
        return F.avg(c)
    if func == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if func == "count":
        return n
    if func == "size":
        return F.count(F.lit(1))
    if func == "min":
        return F.min(c)
    if func == "max":
        return F.max(c)
    if func == "std":
        return F.stddev_samp(c)
    if func == "var":
        return F.var_samp(c)
    if func == "sem":
        return F.stddev_samp(c) / F.sqrt(n)
    if func == "nunique":
        return F.count_distinct(c)
    if func == "prod":
        return F.coalesce(F.product(c), F.lit(1.0))
    if func == "any":
        return F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False))
    if func == "all":
        return F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True))
    if func == "skew":
        flat = F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(F.skewness(c))
        return F.when(n >= 3, F.sqrt((n * (n - 1)).cast("double")) / (n - 2) * flat)
    if func in ("first", "last"):
        if order is None:
            raise ValueError(f"'{func}' needs an order column: a DataFrame has no row order")
        pick = F.min_by if func == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), order))
    return None


FUNCTIONS = [
    "mean", "sum", "count", "size", "min", "max", "median", "std", "var", "nunique", "prod",
    "sem", "first", "last", "any", "all", "skew",
]


def group_summary(
    df: DataFrame, group_col: str, agg_col: str, agg_func: str = "mean", order_col: str | None = None
) -> DataFrame:
    """[key, '<column>_<function>'] sorted by key; rows with a null key are left out."""
    if agg_func not in FUNCTIONS:
        raise ValueError(f"Unknown aggregate '{agg_func}'. Use: {', '.join(FUNCTIONS)}")
    name = f"{agg_col}_{agg_func}"
    rows = df.dropna(subset=[group_col])
    if agg_func == "median":
        return _group_median(rows, group_col, agg_col, name)
    order = F.col(order_col) if order_col else None
    value = _simple_aggregate(agg_func, _present(rows, agg_col), order)
    return rows.groupBy(group_col).agg(value.alias(name)).orderBy(group_col)


def _group_median(rows: DataFrame, group_col: str, agg_col: str, name: str) -> DataFrame:
    medians = Q.group_quantiles(rows, [group_col], agg_col, [0.5], empty_groups=True)
    return medians.select(group_col, F.col("value").alias(name)).orderBy(group_col)


def mean_and_count(
    df: DataFrame, group_col: str, value: str, mean_name: str, count_name: str
) -> DataFrame:
    """Mean rounded to int, halves to even, and the count of values, by key."""
    c = _present(df, value)
    return (
        df.dropna(subset=[group_col])
        .groupBy(group_col)
        .agg(F.rint(F.avg(c)).cast("int").alias(mean_name), F.count(c).alias(count_name))
        .orderBy(group_col)
    )


def class_share(df: DataFrame, label: str, group_col: str | None = None) -> DataFrame:
    """Rows and share of each class, overall or within a group; share with four places.

    One pass: the totals are sums of the class counts, of which a group has one per class.
    """
    keys = [group_col] if group_col else []
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    shares = counts.select(*keys, label, "n", round_half_even(F.col("n") / total, 4).alias("share"))
    return shares.filter(F.col(group_col).isNotNull()) if group_col else shares


def top_n(
    df: DataFrame, column: str, n: int = 10, ascending: bool = False, ties: Sequence[str] = ()
) -> DataFrame:
    """The n largest (smallest) rows by a numeric column, nulls and NaN last.

    ``ties`` are the columns that settle equal values; a DataFrame has no row order.
    """
    if column not in numeric_columns(df):
        raise TypeError(f"Column '{column}' is not numeric")
    c = _present(df, column)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return df.orderBy(first, *(F.col(f"`{t}`").asc() for t in ties)).limit(n)


def preview(df: DataFrame, n: int = 50, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows in a given order."""
    return (df.orderBy(*(f"`{c}`" for c in order)) if order else df).limit(n)


def preview_note(df: DataFrame, n: int = 50) -> DataFrame:
    """One row: 'Showing n of m rows.' when rows were cut, else empty."""
    total = F.count(F.lit(1))
    return df.agg(
        F.when(total > n, F.concat(F.lit(f"Showing {n} of "), total.cast("string"), F.lit(" rows.")))
        .otherwise("")
        .alias("note")
    )


def profile_beside_write(
    df: DataFrame, path: str, marks: dict[str, str] | None = None, numbers: Sequence[str] = (), mode: str = "errorifexists"
) -> DataFrame:
    """Write ``df`` as Parquet and return (metric, column, value) gathered in the pass that writes it.

    Metrics: ``rows``, ``columns``, ``numeric_columns``, ``text_columns``, ``total_nulls`` (column null); ``nulls`` and
    ``non_null`` of each column; ``non_numeric`` of each of ``numbers`` (values that are no numbers, nulls included);
    ``equals`` of each column of ``marks`` (values equal to its marker). Numbers are those of the written rows: each
    task's are added once, when its part of the table is finished. Nothing is read a second time.
    """
    watch = Observation()
    names = df.columns
    facts = [F.count(F.lit(1)).alias("rows")]
    facts += [F.count_if(_missing(df, c)).alias(f"nulls_{i}") for i, c in enumerate(names)]
    facts += [F.count_if(parse_number(f"`{c}`").isNull()).alias(f"bad_{i}") for i, c in enumerate(numbers)]
    marked = list((marks or {}).items())
    facts += [F.count_if(F.col(f"`{c}`") == v).alias(f"mark_{i}") for i, (c, v) in enumerate(marked)]
    df.observe(watch, *facts).write.mode(mode).parquet(path)
    got = watch.get
    rows = [
        ("rows", None, got["rows"]),
        ("columns", None, len(names)),
        ("numeric_columns", None, len(numeric_columns(df))),
        ("text_columns", None, len(text_columns(df))),
        ("total_nulls", None, sum(got[f"nulls_{i}"] for i in range(len(names)))),
    ]
    for i, c in enumerate(names):
        rows += [("nulls", c, got[f"nulls_{i}"]), ("non_null", c, got["rows"] - got[f"nulls_{i}"])]
    rows += [("non_numeric", c, got[f"bad_{i}"]) for i, c in enumerate(numbers)]
    rows += [("equals", c, got[f"mark_{i}"]) for i, (c, _) in enumerate(marked)]
    return df.sparkSession.createDataFrame(rows, "metric string, column string, value long")
