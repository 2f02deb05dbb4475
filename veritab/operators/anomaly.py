"""Business rules on bills, as one array of flags per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.numbers import amount, float_text, thousands
from veritab.functions.text import tariff_key

# Tariff -> usual monthly use in kWh (low, high) and price per kWh.
TARIFFS = {
    "R1/450": (20, 150, 415),
    "R1/900": (50, 300, 605),
    "R1M/900": (50, 300, 1352),
    "R1/1300": (80, 500, 1444),
    "R1/2200": (100, 800, 1444),
    "R2/3500": (150, 1500, 1699),
    "R2/5500": (200, 2500, 1699),
    "R3/6600": (300, 5000, 1699),
    "B1/1300": (100, 1000, 1444),
    "B1/2200": (150, 1500, 1444),
    "B2/6600": (300, 5000, 1444),
}

FLAG = "array<struct<field:string,severity:string,message:string,expected:string,actual:string>>"


def tariff_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in TARIFFS.items()]
    return spark.createDataFrame(rows, "tarif_key string, low int, high int, rate int")


def with_tariff(df: DataFrame, column: str, tariffs: DataFrame | None = None) -> DataFrame:
    """Add tarif_key, low, high, rate; unknown tariffs get nulls.

    The built-in table has eleven rows and is broadcast. A table of one's own is joined
    as its size allows.
    """
    own = tariffs is not None
    table = tariffs if own else F.broadcast(tariff_table(df.sparkSession))
    keyed = df.withColumn("tarif_key", F.expr(tariff_key(f"coalesce(cast(`{column}` as string), '')")))
    return keyed.join(table, "tarif_key", "left").select(*df.columns, "tarif_key", "low", "high", "rate")


def _flag(field: str, severity: str, message, expected: Column, actual: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(severity).alias("severity"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        expected.alias("expected"),
        actual.alias("actual"),
    )


def rule_flags(start: Column, end: Column, usage: Column, bill: Column) -> Column:
    """Flags in rule order; a rule with a missing operand is skipped. Needs ``with_tariff``."""
    diff = end - start
    key, low, high, rate = (F.col(c) for c in ("tarif_key", "low", "high", "rate"))
    usual = F.concat(low.cast("string"), F.lit(" - "), high.cast("string"), F.lit(" kWh"))
    used = F.concat(float_text(usage), F.lit(" kWh"))
    paid = F.try_divide(bill, usage)
    off = F.abs(paid - rate) / rate
    rate_text = F.concat(F.lit("Rp "), thousands(paid), F.lit("/kWh"))

    # Severities, message texts and bounds of the rules.
    rules = [
        F.when(
            end < start,
            _flag(
                "stand_meter_akhir",
                "CRITICAL",
                "Stand meter akhir is LESS than stand meter awal (meter went backwards)",
                F.concat(F.lit("> "), float_text(start)),
                float_text(end),
            ),
        ),
        F.when(
            F.abs(diff - usage) > 1,
            _flag(
                "pemakaian_kwh",
                "CRITICAL",
                F.concat(
                    F.lit("Pemakaian ("), float_text(usage), F.lit(") doesn't match meter difference ("),
                    float_text(diff), F.lit(")"),
                ),
                float_text(diff),
                float_text(usage),
            ),
        ),
        F.when(
            usage < low * 0.5,
            _flag(
                "pemakaian_kwh", "WARNING",
                F.concat(F.lit("Unusually LOW consumption for tariff "), key), usual, used,
            ),
        ).when(
            usage > high * 1.5,
            _flag(
                "pemakaian_kwh", "WARNING",
                F.concat(F.lit("Unusually HIGH consumption for tariff "), key), usual, used,
            ),
        ),
        F.when(
            (usage > 0) & (off > 0.3),
            _flag(
                "biaya_listrik",
                "WARNING",
                F.concat(
                    F.lit("Billing rate "), rate_text, F.lit(" deviates "),
                    F.format_string("%.0f", F.rint(off * 100)), F.lit("% from expected Rp "),
                    rate.cast("string"), F.lit("/kWh"),
                ),
                F.concat(
                    F.lit("~Rp "), rate.cast("string"), F.lit("/kWh (total ~Rp "),
                    thousands(rate * usage), F.lit(")"),
                ),
                F.concat(rate_text, F.lit(" (total Rp "), thousands(bill), F.lit(")")),
            ),
        ),
        F.when(
            usage <= 0,
            _flag("pemakaian_kwh", "WARNING", "Zero or negative consumption", F.lit("> 0"), float_text(usage)),
        ),
        F.when(
            bill <= 0,
            _flag("biaya_listrik", "WARNING", "Zero or negative billing amount", F.lit("> 0"), float_text(bill)),
        ),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull()).cast(FLAG)


BILL_COLUMNS = {
    "stand_meter_awal": "stand_meter_awal",
    "stand_meter_akhir": "stand_meter_akhir",
    "pemakaian_kwh": "pemakaian_kwh",
    "biaya_listrik": "biaya_listrik",
    "tarif_daya": "tarif_daya",
}


def check_rules(
    df: DataFrame, columns: dict[str, str] | None = None, tariffs: DataFrame | None = None,
    output: str = "anomaly_flags",
) -> DataFrame:
    """Add the flags of every row. ``columns`` maps the five bill fields to column names."""
    names = columns or BILL_COLUMNS
    priced = with_tariff(df, names["tarif_daya"], tariffs)
    # Amounts as columns of their own, so that each is parsed once per row.
    parsed = priced.select(
        "*",
        *(
            amount(f"`{names[f]}`").alias(f"_{f}")
            for f in ("stand_meter_awal", "stand_meter_akhir", "pemakaian_kwh", "biaya_listrik")
        ),
    )
    flags = rule_flags(
        F.col("_stand_meter_awal"), F.col("_stand_meter_akhir"), F.col("_pemakaian_kwh"), F.col("_biaya_listrik")
    )
    return parsed.select(*df.columns, flags.alias(output))


def long_flags(checked: DataFrame, keys: list[str], column: str = "anomaly_flags") -> DataFrame:
    """One row per flag.

    The outer form keeps Spark from deriving a filter that evaluates the rules twice.
    """
    return checked.select(*keys, F.inline_outer(column)).filter(F.col("field").isNotNull())
