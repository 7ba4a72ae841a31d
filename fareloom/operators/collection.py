"""Planning and bookkeeping of collection runs, and the small record mappings around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HORIZON_BUCKETS, REQUIRED_COLUMNS, RETRYABLE_STATUSES
from ..functions import columns as C
from .constraints import guarded

COPIES_PER_BLOCK = 10_000


def sample_offsets() -> list[int]:
    """One day offset per horizon bucket: its middle, an open bucket's first day, at least 1."""
    return [max(lo if hi is None else (lo + hi) // 2, 1) for _, lo, hi in HORIZON_BUCKETS]


def request_grid(routes: DataFrame, sources: list[str], today: Column) -> DataFrame:
    """Every source x route x (flight, booking) pair. Sources and offsets are short lists in the row."""
    return (
        routes.select("origin", "destination", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
        .withColumn("offset", F.explode(F.array(*[F.lit(d) for d in sample_offsets()])))
        .select("source", "origin", "destination", F.date_add(today, F.col("offset")).alias("flight_date"), today.alias("booking_date"))
    )


def failure_status(error_class: Column, error_text: Column) -> Column:
    name = F.lower(error_class)
    return (
        F.when(name.contains("timeout"), "TIMEOUT")
        .when(name.contains("rate") | error_text.contains("429"), "RATE_LIMITED")
        .when(name.contains("http") | name.contains("connection"), "HTTP_ERROR")
        .otherwise("PARSE_ERROR")
    )


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE_STATUSES)


def stamp_provenance(df: DataFrame, run_id: str, scraped_at: str) -> DataFrame:
    """Fill run id and scrape time where they are missing."""
    out = df
    for name, value in (("run_id", run_id), ("scraped_at", scraped_at)):
        present = F.col(name) if name in df.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(present, F.lit(value)))
    return out


def map_simple_observations(df: DataFrame) -> DataFrame:
    """(route, fare, date, source) rows as full observations; booking day = flight day.

    Every row has its own id. Rows have no order, so equal rows are counted and numbered; the numbers
    are dealt in blocks, so that a row repeated very often is never one large array.
    """
    ends = F.split("route", "-", 2)
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES_PER_BLOCK))
    blocked = counted.withColumn("_block", F.explode(blocks))
    first = F.col("_block") * COPIES_PER_BLOCK
    last = F.least(F.col("_copies"), first + COPIES_PER_BLOCK) - 1
    numbered = blocked.withColumn("_copy", F.explode(F.sequence(first, last)))
    content = F.xxhash64(F.to_json(F.struct(*df.columns))).cast("string")
    return numbered.select(
        F.concat_ws("-", F.lit("simple"), content, "route", "date", F.col("_copy").cast("string")).alias("observation_id"),
        F.lit("UNKNOWN").alias("airline"),
        ends[0].alias("origin"),
        ends[1].alias("destination"),
        F.col("date").alias("flight_date"),
        F.col("date").alias("booking_date"),
        F.col("fare").alias("total_fare"),
        F.lit("INR").alias("currency"),
        F.col("source"),
    )


def observed_routes(df: DataFrame) -> DataFrame:
    return df.select("origin", "destination").distinct()


def available_periods(df: DataFrame) -> DataFrame:
    return df.select(F.substring(F.col("flight_date").cast("string"), 1, 7).alias("period")).distinct()


def all_mock(df: DataFrame, absent_is_mock: bool = True) -> DataFrame:
    """One row: true when there is no row or every row is a mock."""
    flag = F.col("is_mock") if "is_mock" in df.columns else F.lit(None).cast("boolean")
    return df.agg(F.coalesce(F.bool_and(F.coalesce(flag, F.lit(absent_is_mock))), F.lit(True)).alias("all_mock"))


# --- Ingest ------------------------------------------------------------------------------------


def structurally_usable(df: DataFrame) -> Column:
    """All required fields neither null nor "" (spaces pass here) and a fare above 0."""
    empty = C.any_of(F.col(c).isNull() | (F.col(c).cast("string") == "") for c in REQUIRED_COLUMNS)
    return ~empty & F.coalesce(C.as_number(F.col("total_fare")) > 0, F.lit(False))


def ingest_counts(df: DataFrame) -> DataFrame:
    """One row: loaded, usable, dropped, real and mock rows among the usable."""
    usable = structurally_usable(df)
    mock = F.coalesce(F.col("is_mock"), F.lit(False)) if "is_mock" in df.columns else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(usable).alias("usable"),
        F.count_if(~usable).alias("dropped"),
        F.count_if(usable & ~mock).alias("real_count"),
        F.count_if(usable & mock).alias("mock_count"),
    )


def provenance_problem(counts: DataFrame, allow_mock: bool = False) -> DataFrame:
    """(problem) of the counts of an ingest: real and mock rows mixed without leave, or nothing usable; else null."""
    text = lambda *parts: F.concat(*[F.col(p).cast("string") if p in counts.columns else F.lit(p) for p in parts])
    mixed = (F.col("real_count") > 0) & (F.col("mock_count") > 0) & F.lit(not allow_mock)
    problem = F.when(mixed, text("real_count", " real and ", "mock_count", " mock observations are mixed")).when(
        F.col("usable") == 0, text("no usable observation among ", "loaded", ", ", "dropped", " dropped")
    )
    return counts.select(problem.alias("problem"))


def guarded_ingest(df: DataFrame, allow_mock: bool = False) -> DataFrame:
    """Usable rows; nothing usable, or real and mock rows together without leave, fails the query.

    The counts are a branch of the same plan over the required columns; no action runs here.
    """
    return guarded(df.filter(structurally_usable(df)), provenance_problem(ingest_counts(df), allow_mock))


def window_outcome(flight: Column, booking: Column) -> Column:
    """Where a record goes: its booking window, or why it is in none."""
    days = C.advance_days(flight, booking)
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    return (
        F.when(blank(flight) | blank(booking), "missing_date")
        .when(days.isNull(), "invalid_date")
        .when(days < 0, "negative_horizon")
        .otherwise(F.coalesce(C.booking_window(days), F.lit("out_of_range")))
    )


def partition_accounting(df: DataFrame) -> DataFrame:
    """(outcome, n): every record counted once."""
    outcome = window_outcome(F.col("flight_date"), F.col("booking_date"))
    return df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
