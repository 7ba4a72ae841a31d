"""Price dispersion within a month, and of the monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import VolatilityConfig
from .quantiles import group_moments

INSUFFICIENT = "INSUFFICIENT_DATA"


def classify(value: Column, config: VolatilityConfig) -> Column:
    return (
        F.when(value.isNull(), INSUFFICIENT)
        .when(value < config.low_below, "LOW")
        .when(value > config.high_above, "HIGH")
        .otherwise("MODERATE")
    )


def _with_cv(stats: DataFrame, config: VolatilityConfig) -> DataFrame:
    cv = F.when(F.col("total") >= config.min_observations, F.try_divide("sd", "mean"))
    return stats.withColumn("volatility", cv).withColumn("classification", classify(F.col("volatility"), config))


def route_volatility(kept: DataFrame, config: VolatilityConfig) -> DataFrame:
    """Coefficient of variation per route and month, from the value counts of the kept quotes."""
    stats = _with_cv(group_moments(kept, ["route", "month_ord"], "standardized_fare"), config)
    return stats.select("route", "month_ord", "volatility", "classification", F.col("total").alias("observations_used"))


def horizon_volatility(kept: DataFrame, config: VolatilityConfig) -> DataFrame:
    """The same per month and booking-horizon bucket, routes pooled."""
    keys = ["month_ord", "booking_horizon_bucket"]
    stats = _with_cv(group_moments(kept, keys, "standardized_fare"), config)
    return stats.select(*keys, "volatility", "classification", F.col("total").alias("observations_used"))


def national_volatility(
    per_route: DataFrame, config: VolatilityConfig, weights: DataFrame | None = None
) -> DataFrame:
    """Weighted mean per month; without any weight the plain mean. `weights`: route, weight_normalized."""
    if weights is None:
        rows = per_route.withColumn("w", F.lit(0.0))
    else:
        rows = per_route.join(weights.select("route", F.col("weight_normalized").alias("w")), "route", "left")
    v = F.col("volatility")
    w = F.when(v.isNotNull(), F.coalesce("w", F.lit(0.0)))

    def names(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("classification") == kind, F.col("route"))))

    weighted = F.when(F.sum(w) != 0, F.try_divide(F.sum(v * w), F.sum(w)))
    monthly = rows.groupBy("month_ord").agg(
        F.coalesce(weighted, F.avg(v)).alias("national_volatility"),
        names("HIGH").alias("high_volatility_routes"),
        names("LOW").alias("low_volatility_routes"),
        F.sum("observations_used").alias("observations_used"),
    )
    return monthly.withColumn("national_classification", classify(F.col("national_volatility"), config))


def log_return_stddev(monthly: DataFrame, value: str = "representative_fare") -> DataFrame:
    """Spread of log returns of each route's monthly series; gaps are skipped, not bridged by zeros.

    One return gives its absolute value, none gives null.
    """
    series = monthly.filter(F.col(value).isNotNull())
    before = F.lag(value).over(W.partitionBy("route").orderBy("month_ord"))
    returns = series.withColumn("r", F.ln(F.try_divide(F.col(value), before)))
    return returns.groupBy("route").agg(
        F.when(F.count("r") == 1, F.max(F.abs("r"))).otherwise(F.stddev_samp("r")).alias("volatility"),
        F.count("r").alias("returns"),
    )
