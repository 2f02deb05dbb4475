"""Small column helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of ``text`` in order; null and empty text have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
