"""Number parsing, rounding and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col: Column | str, digits: int = 0) -> Column:
    """Round as numpy does: scale, round half to even, unscale."""
    scale = 10.0**digits
    return F.rint(_c(col).cast("double") * F.lit(scale)) / F.lit(scale)


def parse_number(col: Column | str) -> Column:
    """Text to double, null where it is no plain decimal number.

    ``try_cast`` alone takes '1d', '1f' and 'inf'; the pattern keeps them out.
    """
    text = _c(col).cast("string")
    return F.when(
        text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double")
    )


def strict_number(col: Column | str, to: str = "double") -> Column:
    """Text to number; a bad value raises (ANSI cast)."""
    return _c(col).cast(to)


def parse_date(col: Column | str, fmt: str = "d-M-yyyy") -> Column:
    """Day-month-year text to date, null on failure."""
    return F.try_to_date(_c(col), fmt)


def strict_date(col: Column | str, fmt: str = "d-M-yyyy") -> Column:
    """Day-month-year text to date; a bad value raises."""
    return F.to_date(_c(col), fmt)


def amount(col: Column | str) -> Column:
    """A printed amount to double: '.' and ',' are thousands separators.

    Drops the unit words Rp, rp, kWh, kwh in just these spellings ('RP 5' is null).
    """
    text = F.regexp_replace(_c(col).cast("string"), r"(?U)^\s+|\s+$", "")
    text = F.translate(text, ",. ", "")
    for unit in ("Rp", "rp", "kWh", "kwh"):
        text = F.replace(text, F.lit(unit), F.lit(""))
    return parse_number(text)


def deviation_number(side: Column | str) -> Column:
    """A separator-free number for ``deviation``: empty is 0, unparsable text null."""
    side = _c(side)
    return F.when(F.coalesce(side, F.lit("")) == "", F.lit(0.0)).otherwise(parse_number(side))


def deviation(value: Column | str, base: Column | str) -> Column:
    """min(|value - base| / base, 1) of numbers. A zero base gives 0, a null 0.5."""
    v, b = _c(value), _c(base)
    return (
        F.when(v.isNull() | b.isNull(), F.lit(0.5))
        .when(b == 0, F.lit(0.0))
        .otherwise(F.least(F.try_divide(F.abs(v - b), b), F.lit(1.0)))
    )


def relative_deviation(value: Column | str, base: Column | str) -> Column:
    """min(|value - base| / base, 1) of separator-free numbers (``strip_separators``).

    An empty side counts as 0; a zero base gives 0; unparsable text gives 0.5.
    """
    return deviation(deviation_number(value), deviation_number(base))


def nan_to_null(col: Column | str) -> Column:
    """NaN is a missing value in every sink."""
    col = _c(col)
    return F.when(~F.isnan(col), col)


def float_text(col: Column | str) -> Column:
    """A whole-valued double as '15230.0' (Spark alone prints 1.523E7)."""
    col = _c(col)
    return F.when(F.abs(col) < 1e16, F.format_string("%.1f", col)).otherwise(
        F.regexp_replace(col.cast("string"), r"(\.0)?E", "e+")
    )


def thousands(col: Column | str) -> Column:
    """12345.6 as '12,346', halves to even."""
    return F.format_string("%,.0f", F.rint(_c(col)))


def two_places(col: Column | str) -> Column:
    """12345.678 as '12,345.68'."""
    return F.format_string("%,.2f", round_half_even(col, 2))


def signed_weight(col: Column | str) -> Column:
    """0.25 as '+0.2500'."""
    return F.format_string("%+.4f", round_half_even(col, 4))


def percent_text(col: Column | str) -> Column:
    """0.25 as '25%'."""
    return F.concat(F.format_string("%.0f", F.rint(_c(col) * 100)), F.lit("%"))


#: Ten-thousandths ending in 50 whose double lies above the decimal tie, so that
#: printing them with two places rounds up. Derived, not listed.
_TIES_UP = [k for k in range(50, 10001, 100) if round(float(f"{k / 10000:.2f}") * 10000) > k]


def score_text(score: str) -> str:
    """SQL text: a score of four decimals printed with two, ties by its binary value."""
    k = f"cast(rint({score} * 10000) as int)"
    tie = f"if({k} in ({', '.join(map(str, _TIES_UP))}), {k} + 50, {k} - 50)"
    return f"format_string('%.2f', if({k} % 100 = 50, {tie}, cast(rint({k} / 100D) as int) * 100) / 10000D)"
