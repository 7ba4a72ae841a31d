"""Airfare index relative to an income series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .cleaning import first_per_key


def affordability(national: DataFrame, income: DataFrame, indicator: str) -> DataFrame:
    """One row per month: airfare over income times 100, or DATA_UNAVAILABLE."""
    missing = [c for c in ("period", "indicator", "value") if c not in income.columns]
    if missing:
        raise ValueError(f"income series lacks columns: {missing}")
    work = income if "source" in income.columns else income.withColumn("source", F.lit(None).cast("string"))
    series = work.filter(F.col("indicator") == indicator).select(
        C.period_ord_of(F.col("period")).alias("month_ord"), "value", "source"
    )
    series = first_per_key(series, ["month_ord"], ()).withColumnRenamed("value", "income_index")
    out = national.select("month_ord", "period", F.col("national_index").alias("airfare_index")).join(
        series, "month_ord", "left"
    )
    usable = F.col("airfare_index").isNotNull() & (F.coalesce("income_index", F.lit(0.0)) != 0)
    return out.select(
        "period",
        F.lit(indicator).alias("indicator"),
        "airfare_index",
        F.when(usable, F.col("income_index")).alias("income_index"),
        F.when(usable, F.try_divide("airfare_index", "income_index") * 100.0).alias("relative_affordability"),
        F.when(usable, "OK").otherwise("DATA_UNAVAILABLE").alias("status"),
        F.when(usable, F.col("source")).alias("source"),
    )
