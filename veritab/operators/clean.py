"""Filters, computed columns, buckets, dedup and domain checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.numbers import parse_number
from veritab.functions.text import snake_case

OPERATORS = ["==", "!=", ">", "<", ">=", "<=", "contains", "startswith"]


def condition(column: str, operator: str, value, literal: bool = False) -> Column:
    """One filter as a Boolean column.

    ``!=`` keeps nulls. ``contains`` is a case-insensitive regular expression, or plain
    text with ``literal``. A null neither contains nor starts with anything.
    """
    c = F.col(f"`{column}`")
    text = c.cast("string")
    if operator == "==":
        return c == F.lit(value)
    if operator == "!=":
        return ~c.eqNullSafe(F.lit(value))
    if operator == ">":
        return c > F.lit(value)
    if operator == "<":
        return c < F.lit(value)
    if operator == ">=":
        return c >= F.lit(value)
    if operator == "<=":
        return c <= F.lit(value)
    if operator == "contains":
        pattern = re.escape(str(value)) if literal else str(value)
        return text.rlike("(?iU)" + pattern)
    if operator == "startswith":
        return text.startswith(str(value))
    raise ValueError(f"Unknown operator '{operator}'. Use: {', '.join(OPERATORS)}")


def filter_rows(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """Keep rows that meet every {column, operator, value}; one conjunction for the scan."""
    if not filters:
        return df
    return df.filter(
        reduce(
            and_,
            (
                condition(f["column"], f["operator"], f["value"], f.get("literal", False))
                for f in filters
            ),
        )
    )


def describe_filters(filters: Sequence[dict]) -> str:
    return ", ".join(f"{f['column']} {f['operator']} {f['value']}" for f in filters)


def computed_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add or replace a column by a Spark SQL expression.

    Differs from Python on purpose: use ``pmod`` and ``floor`` for negative operands and
    ``try_divide`` where a divisor may be zero.
    """
    return df.withColumn(name, F.expr(expression))


def rename_snake_case(df: DataFrame, spelling: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: snake_case(c, spelling) for c in df.columns})


def bucketize(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open buckets from descending lower ``edges``; the last label takes all else, nulls too."""
    c = F.col(col) if isinstance(col, str) else col
    chain = F.when(c >= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        chain = chain.when(c >= edge, label)
    return chain.otherwise(labels[len(edges)])


def drop_where_all(df: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Drop rows in which every listed column holds its marker."""
    hit = reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in marks.items()))
    return df.filter(~hit)


def non_numeric_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is no number; nulls included."""
    return df.filter(parse_number(f"`{column}`").isNull())


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def check_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows outside the allowed values; blank and null pass."""
    c = F.col(f"`{column}`")
    return df.filter((c != "") & ~c.isin(*allowed))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a number type; Booleans are none."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def ordinal(col: Column | str, order: Sequence[str]) -> Column:
    """Position of a category in ``order``; null when unknown."""
    c = F.col(col) if isinstance(col, str) else col
    return F.create_map(*(F.lit(x) for i, v in enumerate(order) for x in (v, i)))[c]


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One 0/1 column per category, named '<column>_<category>'."""
    return df.select(
        "*",
        *(
            F.col(f"`{column}`").eqNullSafe(F.lit(v)).cast("int").alias(f"{column}_{v}")
            for v in categories
        ),
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each set of identical rows. Copies collapse before the shuffle."""
    return df.dropDuplicates()


def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*(f"`{c}`" for c in df.columns)).agg(F.count(F.lit(1)).alias("_n"))


def duplicate_members(df: DataFrame) -> DataFrame:
    """Every row that has an identical twin, nulls being equal.

    A semi-join against the repeated rows instead of a count over a window: the right
    side is unique and each left row stands alone, so a hot row can be split by AQE.
    """
    twins = _copies(df).filter("_n > 1").drop("_n")
    renamed = twins.withColumnsRenamed({c: f"_t_{c}" for c in df.columns})
    same = reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.col(f"`_t_{c}`")) for c in df.columns))
    return df.join(renamed, same, "left_semi")


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows exceed the first of their kind."""
    return _copies(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def missing_fields(found: Column, expected: Sequence[str]) -> Column:
    """Sorted names of ``expected`` that the array ``found`` lacks."""
    return F.array_sort(F.array_except(F.array(*(F.lit(v) for v in expected)), found))
