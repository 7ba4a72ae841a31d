"""Duplicate quotes and outlying fares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..session import stage
from .quantiles import exact_percentiles, value_counts

ORDER_COLS = ("scraped_at", "observation_id", "total_fare")
MIN_GROUP = 4


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str] = ORDER_COLS, count_as: str | None = None
) -> DataFrame:
    """The first row of every key.

    "First" is the least row by `order_cols`, then by all other columns, so the result does not
    depend on how rows are spread. A struct minimum combines map-side: one id repeated across
    the whole input sends one row per task, where a window would sort all its copies in one.
    """
    order = [c for c in order_cols if c in df.columns and c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    aggs = [F.min(F.struct(*order, *rest)).alias("kept")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    grouped = df.groupBy(*keys).agg(*aggs)
    columns = [F.col(c) if c in keys else F.col(f"kept.{c}").alias(c) for c in df.columns]
    return grouped.select(*columns, *([count_as] if count_as else []))


def drop_duplicates(df: DataFrame, order_cols: Sequence[str] = ORDER_COLS) -> DataFrame:
    """One row per observation id, the first."""
    return first_per_key(df, ["observation_id"], order_cols)


def fare_counts(quotes: DataFrame, keys: Sequence[str] = ("route", "month_ord")) -> DataFrame:
    """Quotes reduced to (keys, fare, n). Everything after the dedup reads this table."""
    return value_counts(quotes, keys, "standardized_fare")


def outlier_limits(counts: DataFrame, keys: Sequence[str], config: IndexConfig) -> DataFrame | None:
    """Per group the limits of the configured rule; groups under four rows get none."""
    fare = "standardized_fare"
    if config.outlier_method == "none":
        return None
    if config.outlier_method == "mad":
        # One row per group, read for the deviations and for the result.
        middle = exact_percentiles(counts, keys, {"center": 0.5}, fare).filter(F.col("total") >= MIN_GROUP)
        middle = stage(middle, "fare-centers")
        away = counts.join(middle, list(keys)).withColumn("deviation", F.abs(F.col(fare) - F.col("center")))
        spread = value_counts(away, keys, "deviation", "n")
        mad = exact_percentiles(spread, keys, {"mad": 0.5}, "deviation").filter(F.col("mad") != 0)
        return middle.join(mad.drop("total"), list(keys)).drop("total")
    if config.outlier_method == "iqr":
        q = exact_percentiles(counts, keys, {"q1": 0.25, "q3": 0.75}, fare)
        width = F.col("q3") - F.col("q1")
        reach = F.lit(config.outlier_iqr_multiplier) * width
        lower, upper, usable = F.col("q1") - reach, F.col("q3") + reach, width != 0
    else:
        lo, hi = config.outlier_percentile_bounds
        q = exact_percentiles(counts, keys, {"q1": lo, "q3": hi}, fare)
        lower, upper, usable = F.col("q1"), F.col("q3"), F.lit(True)
    return q.filter((F.col("total") >= MIN_GROUP) & usable).select(
        *keys, lower.alias("lower"), upper.alias("upper")
    )


def flag_outliers(
    counts: DataFrame, keys: Sequence[str], config: IndexConfig, limits: DataFrame | None = None
) -> DataFrame:
    """Value counts with `is_outlier`. Comparisons are strict, a group without limits has none.

    `limits` may be passed in when they are already staged.
    """
    if limits is None:
        limits = outlier_limits(counts, keys, config)
    if limits is None:
        return counts.withColumn("is_outlier", F.lit(False))
    fare = F.col("standardized_fare")
    joined = counts.join(limits, list(keys), "left")
    if config.outlier_method == "mad":
        score = F.abs(F.lit(0.6745) * (fare - F.col("center")) / F.col("mad"))
        flag = score > config.outlier_mad_threshold
    else:
        flag = (fare < F.col("lower")) | (fare > F.col("upper"))
    return joined.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).select(*counts.columns, "is_outlier")


def survivors(counts: DataFrame, keys: Sequence[str], config: IndexConfig) -> DataFrame:
    return flag_outliers(counts, keys, config).filter(~F.col("is_outlier")).drop("is_outlier")
