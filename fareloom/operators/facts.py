"""The central fact: one representative fare per route and month, for all months at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import columns as C
from .quantiles import exact_percentiles, trimmed_means


def representative_fares(kept: DataFrame, keys: Sequence[str], config: IndexConfig) -> DataFrame:
    """Per group: representative_fare, observations_used, sufficient, mean, sd."""
    stats = exact_percentiles(kept, keys, {"median": 0.5}, "standardized_fare", moments=True)
    if config.representative_method == "median":
        fare = F.col("median")
    elif config.representative_method == "mean":
        fare = F.col("mean")
    else:
        trimmed = trimmed_means(kept, keys, config.trimmed_mean_proportion, "standardized_fare")
        stats = stats.join(trimmed, list(keys), "left")
        fare = F.when(F.col("total") < 3, F.col("median")).otherwise(F.col("trimmed_mean"))
    return stats.select(
        *keys,
        fare.alias("representative_fare"),
        F.col("total").alias("observations_used"),
        (F.col("total") >= config.min_observations).alias("sufficient"),
        "mean",
        "sd",
    )


def route_period_fares(kept: DataFrame, config: IndexConfig) -> DataFrame:
    """`representative_fares` per (route, month), with the month as text. Thin groups stay in."""
    facts = representative_fares(kept, ["route", "month_ord"], config)
    return facts.withColumn("period", C.period_text(F.col("month_ord")))
