"""Health of sources and routes, from graded rows and the log of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QualityConfig
from ..functions import columns as C

IDENTITY_REASONS = (
    "MISSING_OBSERVATION_ID",
    "MISSING_AIRLINE",
    "MISSING_ORIGIN",
    "MISSING_DESTINATION",
    "MISSING_CURRENCY",
)


def _rows(test: Column) -> Column:
    return F.sum(F.when(test, F.col("copies")).otherwise(0))


def source_health(
    graded: DataFrame,
    attempts: DataFrame | None = None,
    reference_time: Column | None = None,
    config: QualityConfig = QualityConfig(),
) -> DataFrame:
    """One row per source that delivered rows, with the figures of its attempts if any.

    Ages are measured against `reference_time`; without it they are measured against now.
    """
    unknown = F.lit("UNKNOWN_SOURCE")
    named = F.when(F.col("source") != "", F.col("source")) if "source" in graded.columns else F.lit(None).cast("string")
    ts = C.as_instant(graded, "timestamp") if "timestamp" in graded.columns else F.lit(None).cast("timestamp")
    status = F.col("status")
    by_source = (
        graded.select(F.coalesce(named, unknown).alias("src"), "status", "copies", ts.alias("ts"))
        .groupBy(F.col("src").alias("source"))
        .agg(
            F.sum("copies").alias("observations_received"),
            _rows(status == "VALID").alias("valid_observations"),
            _rows(status == "FLAGGED").alias("flagged_observations"),
            _rows(status == "REJECTED").alias("rejected_observations"),
            F.min("ts").alias("oldest_observation"),
            F.max("ts").alias("newest_observation"),
        )
    )
    now = reference_time if reference_time is not None else F.current_timestamp()
    age = (F.unix_micros(now) - F.unix_micros("newest_observation")) / 1e6
    out = by_source.withColumns(
        {
            "observation_validity_rate": F.coalesce(
                F.try_divide("valid_observations", "observations_received"), F.lit(0.0)
            ),
            "data_age_seconds": F.when(F.col("newest_observation").isNotNull(), F.greatest(F.lit(0.0), age)),
        }
    )
    if attempts is None:
        for name in ("routes_requested", "routes_successful", "routes_failed"):
            out = out.withColumn(name, F.lit(None).cast("long"))
    else:
        log = attempts.select("source", "routes_requested", "routes_successful", "routes_failed")
        out = out.join(log, "source", "left")
        known = F.col("routes_requested").isNotNull() & F.col("routes_successful").isNotNull()
        failed = F.coalesce("routes_failed", F.col("routes_requested") - F.col("routes_successful"))
        out = out.withColumn("routes_failed", F.when(known, failed))
    rate = F.when(
        F.col("routes_requested").isNotNull() & F.col("routes_successful").isNotNull(),
        F.coalesce(F.try_divide("routes_successful", "routes_requested"), F.lit(0.0)),
    )
    out = out.withColumn("route_success_rate", rate)
    success = F.col("route_success_rate")
    degraded = (F.col("observation_validity_rate") < config.degraded_validity_below) | F.coalesce(
        success < config.degraded_success_below, F.lit(False)
    )
    word = (
        F.when((F.col("observations_received") == 0) | (success == 0), "FAILED")
        .when(degraded, "DEGRADED")
        .otherwise("HEALTHY")
    )
    return out.withColumn("status", word)


def route_success_rate(health: DataFrame) -> DataFrame:
    """Mean success over sources, weighted by requests; null when no source has a rate."""
    known = F.col("route_success_rate").isNotNull()
    weight = F.when(known, F.col("routes_requested"))
    return health.agg(F.try_divide(F.sum(F.col("route_success_rate") * weight), F.sum(weight)).alias("route_success_rate"))


def route_coverage(graded: DataFrame, attempts: DataFrame) -> DataFrame:
    """Share of attempted routes that delivered a row that was not rejected."""
    attempted = attempts.select(F.explode("routes_attempted").alias("route")).distinct()
    observed = graded.filter(F.col("status") != "REJECTED").select("route").distinct().withColumn("seen", F.lit(1))
    return attempted.join(observed, "route", "left").agg(
        F.try_divide(F.count("seen"), F.count(F.lit(1))).alias("route_coverage")
    )


def route_health(graded: DataFrame, base_period: str | None = None, current_period: str | None = None) -> DataFrame:
    """One row per route (rejected rows included) with quality rate, completeness and period presence."""
    rejected = F.col("rejection_reason").isNotNull()
    anonymous = F.coalesce(F.col("rejection_reason").isin(*IDENTITY_REASONS), F.lit(False))
    month = C.month_ord(F.col("flight_day"))

    def seen(period: str | None) -> Column:
        if period is None or base_period is None:
            return F.lit(None).cast("boolean")
        return F.coalesce(F.bool_or(month == C.period_ord(period)), F.lit(False))

    out = graded.groupBy("route").agg(
        F.sum("copies").alias("observations_total"),
        _rows(~rejected).alias("observations_valid"),
        _rows(rejected).alias("observations_rejected"),
        (_rows(~anonymous) / F.sum("copies")).alias("data_completeness"),
        seen(base_period).alias("has_base_period_data"),
        seen(current_period).alias("has_current_period_data"),
    )
    parts = F.split("route", "-", 2)
    return out.withColumns(
        {
            "origin": parts[0],
            "destination": parts[1],
            "route_quality_rate": F.try_divide("observations_valid", "observations_total"),
        }
    )


# --- Collection runs ---------------------------------------------------------------------------


def run_report(calls: DataFrame) -> DataFrame:
    """Per source: routes attempted, successful (any SUCCESS) and failed, and what was collected."""
    per_route = calls.groupBy("source", "route").agg(
        F.bool_or(F.col("status") == "SUCCESS").alias("ok"),
        F.sum(F.when(F.col("status") == "SUCCESS", F.col("n_observations")).otherwise(0)).alias("n"),
        F.count_if(F.col("status") != "SUCCESS").alias("failed_calls"),
    )
    return per_route.groupBy("source").agg(
        F.count(F.lit(1)).alias("routes_requested"),
        F.count_if("ok").alias("routes_successful"),
        F.count_if(~F.col("ok")).alias("routes_failed"),
        F.sum("n").alias("observations_collected"),
        F.sum("failed_calls").alias("failed_calls"),
        F.sort_array(F.collect_list("route")).alias("routes_attempted"),
    )


def failure_breakdown(calls: DataFrame) -> DataFrame:
    """Calls that did not succeed, per source and status."""
    return calls.filter(F.col("status") != "SUCCESS").groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def overall_success(calls: DataFrame) -> DataFrame:
    """Routes requested, and routes that any source delivered."""
    routes = calls.groupBy("route").agg(F.bool_or(F.col("status") == "SUCCESS").alias("ok"))
    return routes.agg(
        F.count(F.lit(1)).alias("routes_requested"),
        F.count_if("ok").alias("routes_successful"),
        F.count_if(~F.col("ok")).alias("routes_failed"),
    )
