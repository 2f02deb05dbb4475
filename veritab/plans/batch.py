"""A table of bills checked in one call: rules and isolation forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.anomaly import BILL_COLUMNS, check_rules
from veritab.operators.isolation import CONTAMINATION, isolation_forest

#: The bill fields that the forest looks at.
NUMBERS = ["stand_meter_awal", "stand_meter_akhir", "pemakaian_kwh", "biaya_listrik"]


def check_batch(
    df: DataFrame, id_cols: Sequence[str], columns: dict[str, str] | None = None, contamination: float = CONTAMINATION
) -> DataFrame:
    """Every row with anomaly_score (-1 or 1), is_anomaly and anomaly_flags.

    ``columns`` maps the five bill fields to column names; fields whose column is absent take no part.
    """
    names = columns or BILL_COLUMNS
    there = {f: c for f, c in names.items() if c in df.columns}
    labelled = isolation_forest(df, id_cols, [there[f] for f in NUMBERS if f in there], contamination).drop("isolation")
    absent = {f"_no_{f}": F.lit(None).cast("string") for f in BILL_COLUMNS if f not in there}
    flagged = check_rules(labelled.withColumns(absent), {f: there.get(f, f"_no_{f}") for f in BILL_COLUMNS})
    return flagged.drop(*absent)
