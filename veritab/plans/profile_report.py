"""The tabular report: profile, filtered rows, one grouping and the top records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import profile as P
from veritab.operators.clean import describe_filters, filter_rows
from veritab.sources.sinks import write_report

#: Tables a report leaves out when they are empty.
OPTIONAL = {"filtered", "grouped", "top_records"}


def profile_report(
    df: DataFrame,
    title: str = "Report",
    filters: Sequence[dict] | None = None,
    group_by: dict | None = None,
    top_n: dict | None = None,
    ties: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Result tables by name. Grouping and top records read the unfiltered table.

    ``group_by`` takes group_col, agg_col, agg_func; ``top_n`` takes column, n, ascending.
    """
    tables = {
        "overview": P.overview(df),
        "column_info": P.column_info(df),
        "statistics": P.describe(df),
        "full_data": df,
    }
    if filters:
        tables["filtered"] = filter_rows(df, filters)
    if group_by:
        tables["grouped"] = P.group_summary(
            df, group_by["group_col"], group_by["agg_col"], group_by.get("agg_func", "mean"), group_by.get("order_col")
        )
    if top_n:
        tables["top_records"] = P.top_n(df, top_n["column"], top_n.get("n", 10), top_n.get("ascending", False), ties)
    spark = df.sparkSession
    tables["run"] = spark.range(1).select(
        F.lit(title).alias("title"),
        F.lit(describe_filters(filters or [])).alias("filters"),
        F.current_timestamp().alias("generated_at"),
    )
    return tables


def write_profile_report(tables: dict[str, DataFrame], folder: str, base_name: str, **options) -> str:
    return write_report(tables, folder, base_name, optional=OPTIONAL, **options)
