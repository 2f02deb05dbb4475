"""Cleaning and summaries of a player ranking whose columns all arrive as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.numbers import strict_date, strict_number
from veritab.operators.clean import bucketize, drop_duplicate_rows, drop_missing, drop_where_all
from veritab.operators.profile import mean_and_count

# Markers of bad rows, of a missing country, and the rating classes.
JUNK = {"rank": "e", "rating": "N"}
NO_COUNTRY = "FIDE"
UNUSED = ["profileimage", "profilelink"]
RATING_EDGES = [2800, 2700, 2600, 2500]
RATING_LABELS = ["2800+", "2700-2799", "2600-2699", "2500-2599", "Below 2500"]


def clean_players(raw: DataFrame) -> DataFrame:
    """Drop junk, players without country, duplicates and players without title; then cast.

    A value that is no number or no date raises.
    """
    kept = drop_where_all(raw, JUNK).filter(~F.col("country").eqNullSafe(F.lit(NO_COUNTRY)))
    unique = drop_missing(drop_duplicate_rows(kept), ["title"]).drop(*UNUSED)
    return unique.withColumns(
        {
            "rank": strict_number("rank", "bigint"),
            "rating": strict_number("rating", "bigint"),
            "lastupdated": strict_date("lastupdated"),
        }
    ).withColumn("rating_category", bucketize("rating", RATING_EDGES, RATING_LABELS))


def average_rating(clean: DataFrame, by: str) -> DataFrame:
    """Average rating, rounded half to even, and number of players by title or country."""
    return mean_and_count(clean, by, "rating", "average_rating", "player_count")


def player_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The three output tables."""
    clean = clean_players(raw)
    return {
        "chess_df": clean,
        "avg_country": average_rating(clean, "country"),
        "avg_title": average_rating(clean, "title"),
    }
