"""The summary a dashboard opens with, as one row per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality, ranking


def dashboard_summary(
    national: DataFrame, listing: DataFrame, inflation: DataFrame, report: DataFrame, is_real: Column
) -> DataFrame:
    """Index, movers, coverage, quality and provenance of every month of `national`.

    `listing` comes from `route_listing`, `report` from `batch_report`. Provenance is "real" only
    when every part is. Lists hold at most three entries.
    """
    rows = ranking.movers(inflation)
    entry = F.struct("rank", "route", "value")
    named = {"top_increases": "increase", "top_decreases": "decrease", "top_contributors": "contributor"}
    lists = rows.groupBy("period").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("list") == kind, entry))).alias(out) for out, kind in named.items()]
    )
    origin = listing.groupBy("period").agg(F.bool_and(F.col("data_source") == "real").alias("routes_real"))
    out = (
        national.select("period", "national_index", "mom_change_pct", "yoy_change_pct")
        .join(lists, "period", "left")
        .join(ranking.dashboard_coverage(listing), "period", "left")
        .join(origin, "period", "left")
    )
    score = report.select("quality_score").scalar()
    return out.withColumns(
        {
            "quality_score": F.round(score / 100.0, 4),
            "quality_grade": quality.letter_grade(score),
            "data_source": F.when(F.coalesce("routes_real", F.lit(False)) & is_real, "real").otherwise("synthetic"),
        }
    ).drop("routes_real")
