"""Text normalisation.

Functions take and return SQL text, so that they nest freely and reach the JVM as one
expression: ``F.expr(normalize("c_name"))``. Quote odd column names with backticks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Address abbreviations and their long forms, applied in this order.
ABBREVIATIONS = [
    ("jl", "jalan"),
    ("gg", "gang"),
    ("rt", "rt"),
    ("rw", "rw"),
    ("kel", "kelurahan"),
    ("kec", "kecamatan"),
    ("kab", "kabupaten"),
    ("no", "nomor"),
    ("blk", "blok"),
    ("jkt", "jakarta"),
    ("tmr", "timur"),
    ("brt", "barat"),
    ("slt", "selatan"),
    ("utr", "utara"),
    ("ds", "desa"),
    ("perum", "perumahan"),
    ("komp", "kompleks"),
]

# Lower bounds of the similarity classes.
SIMILARITY_CLASSES = [(0.95, "EXACT"), (0.80, "HIGH"), (0.60, "MEDIUM"), (0.40, "LOW")]
NO_SIMILARITY = "NO_MATCH"


def quoted(text: str) -> str:
    """A SQL string literal of any text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replaced(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)})"


def strip(x: str) -> str:
    """Drop leading and trailing whitespace of every kind (``trim`` drops blanks only)."""
    return replaced(x, r"(?U)^\s+|\s+$")


def normalize(x: str) -> str:
    """Strip, upper-case, collapse whitespace; null is empty."""
    text = replaced(f"upper({strip(f'cast({x} as string)')})", r"(?U)\s+", " ")
    return f"coalesce({text}, '')"


def strip_separators(x: str) -> str:
    """``normalize``, then without Rp, '.', ',' and whitespace: 'Rp 352.500' -> '352500'."""
    return replaced(replaced(normalize(x), r"(?U)[Rr][Pp]\.?\s*"), r"(?U)[.,\s]")


def tariff_key(x: str) -> str:
    """'R1-1300 VA' -> 'R1/1300'."""
    text = f"replace(replace(upper({strip(x)}), ' ', ''), '-', '/')"
    text = f"replace(replace({text}, 'VA', ''), 'W', '')"
    return replaced(strip(text), "/+$")


#: Abbreviations that most addresses have; texts with none of the others skip those.
COMMON = ("jl", "rt", "rw", "no")


def _any_of(shorts: list[str]) -> str:
    return quoted(rf"(?iU)\b({'|'.join(shorts)})\b")


def normalize_address(x: str) -> str:
    """Lower-case, long forms for abbreviations, punctuation to single blanks.

    A text is searched for the abbreviations it may have, not for each: no replacement makes a word that is one.
    """
    plain = strip(f"lower(cast({x} as string))")

    def expanded(shorts: list[str]) -> str:
        text = plain
        for short, long in ABBREVIATIONS:
            if short in shorts:
                text = replaced(text, rf"(?iU)\b{short}\.?\b", long)
        return text

    every = [short for short, _ in ABBREVIATIONS]
    rare = [short for short in every if short not in COMMON]
    text = (
        f"case when not rlike({plain}, {_any_of(every)}) then {plain} "
        f"when not rlike({plain}, {_any_of(rare)}) then {expanded([*COMMON])} else {expanded(every)} end"
    )
    text = replaced(replaced(text, r"[,.\-/\\]+", " "), r"(?U)\s+", " ")
    return f"coalesce({strip(text)}, '')"


def contains_either(x: str, y: str) -> str:
    """Whether one normalised text contains the other; false if either is empty."""
    return f"({x} <> '' and {y} <> '' and (contains({x}, {y}) or contains({y}, {x})))"


def similarity_class(score: str) -> str:
    cases = " ".join(f"when {score} >= {bound} then '{name}'" for bound, name in SIMILARITY_CLASSES)
    return f"case {cases} else '{NO_SIMILARITY}' end"


def fixed_width(x: str, width: int, empty: str = "") -> str:
    """The first ``width`` characters for a fixed-width print; null prints ``empty``."""
    return f"left(coalesce(nullif(cast({x} as string), ''), {quoted(empty)}), {width})"


@F.pandas_udf(T.StringType())
def latin1_text(text: pd.Series) -> pd.Series:
    """Compatibility-decompose, then '?' for what Latin-1 cannot encode.

    Spark has no normalisation function, and ``encode`` raises on unmappable characters.
    """
    return text.map(_latin1, na_action="ignore")


def _latin1(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("latin-1", errors="replace").decode("latin-1")


def snake_case(name: str, spelling: dict[str, str] | None = None) -> str:
    """'Average_montly Hours' -> 'average_monthly_hours' with a spelling table."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return (spelling or {}).get(name, name)
