"""Comparison of the national index with an official monthly series (one row per month each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .indices import calendar_lag


def overlap(ours: DataFrame, official: DataFrame) -> DataFrame:
    """Months with a value on both sides. `ours`: month_ord, value; `official`: month_ord, index, imputed."""
    a = ours.filter(F.col("value").isNotNull()).select("month_ord", F.col("value").alias("our_index"))
    b = official.filter(F.col("index").isNotNull()).select("month_ord", F.col("index").alias("official_index"), "imputed")
    return a.join(b, "month_ord")


def rebased(value: str) -> Column:
    """100 at the first month of the overlap; null when that value is 0."""
    first = F.first(value).over(W.partitionBy(F.lit(1)).orderBy("month_ord"))
    return 100.0 * F.try_divide(F.col(value), first)


def compare(ours: DataFrame, official: DataFrame, exclude_imputed: bool = True) -> DataFrame:
    """Rebased levels and changes per overlap month.

    A change needs the month exactly 1 (12) months earlier in the overlap and both months
    included; imputed months are listed but by default not included.
    """
    included = ~F.col("imputed") if exclude_imputed else F.lit(True)
    base = overlap(ours, official).withColumns(
        {"our_rebased": rebased("our_index"), "official_rebased": rebased("official_index"), "included": included}
    )
    changes = {}
    for tag, months in (("mom", 1), ("yoy", 12)):
        was_in = F.coalesce(calendar_lag("included", months), F.lit(False)) & F.col("included")
        ours_before, official_before = calendar_lag("our_rebased", months), calendar_lag("official_rebased", months)
        usable = was_in & (ours_before != 0) & (official_before != 0)
        changes[f"our_{tag}_pct"] = F.when(usable, C.pct_change(F.col("our_rebased"), ours_before))
        changes[f"official_{tag}_pct"] = F.when(usable, C.pct_change(F.col("official_rebased"), official_before))
    out = base.withColumns(changes)
    return out.withColumns(
        {
            "mom_difference": F.col("our_mom_pct") - F.col("official_mom_pct"),
            "yoy_difference": F.col("our_yoy_pct") - F.col("official_yoy_pct"),
            "period": C.period_text(F.col("month_ord")),
        }
    )


def summary(comparison: DataFrame) -> DataFrame:
    """One row: overlap, mean absolute differences, correlation of monthly changes, statuses."""
    x, y = F.col("our_mom_pct"), F.col("official_mom_pct")
    out = comparison.agg(
        F.min("period").alias("overlap_start"),
        F.max("period").alias("overlap_end"),
        F.count(F.lit(1)).alias("overlap_period_count"),
        F.count("mom_difference").alias("mom_pairs"),
        F.count("yoy_difference").alias("yoy_pairs"),
        F.avg(F.abs("mom_difference")).alias("mad_mom"),
        F.avg(F.abs("yoy_difference")).alias("mad_yoy"),
        F.covar_pop(x, y).alias("cov"),
        F.var_pop(F.when(y.isNotNull(), x)).alias("var_x"),
        F.var_pop(F.when(x.isNotNull(), y)).alias("var_y"),
    )
    correlation = F.when(
        (F.col("mom_pairs") >= 4) & (F.col("var_x") != 0) & (F.col("var_y") != 0),
        F.try_divide(F.col("cov"), F.sqrt(F.col("var_x") * F.col("var_y"))),
    )
    empty = F.col("overlap_period_count") == 0
    none = F.lit("INSUFFICIENT_OVERLAP")
    return out.select(
        "overlap_start",
        "overlap_end",
        "overlap_period_count",
        F.col("overlap_start").alias("rebase_period"),
        F.when(F.col("mom_pairs") >= 2, F.col("mad_mom")).alias("mean_absolute_mom_difference"),
        correlation.alias("mom_correlation"),
        F.when(empty, none).when(correlation.isNull(), "INSUFFICIENT_DATA").otherwise("OK").alias("mom_correlation_status"),
        F.when(F.col("yoy_pairs") >= 2, F.col("mad_yoy")).alias("mean_absolute_yoy_difference"),
        F.col("yoy_pairs").alias("yoy_period_count"),
        F.when(empty, none).when(F.col("yoy_pairs") == 0, "INSUFFICIENT_DATA").otherwise("OK").alias("yoy_status"),
        F.when(empty, none).otherwise("OK").alias("status"),
    )
