"""Grading of a batch of raw quotes: rejection reasons, flags, status, rates and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QualityConfig
from ..constants import AIRPORTS, KNOWN_AIRLINES, OPTIONAL_COLUMNS, REQUIRED_COLUMNS
from ..functions import columns as C
from ..session import stage
from .cleaning import ORDER_COLS
from .duplicates import distinct_rows, mark_exact, mark_near, row_keys, row_order
from .quantiles import exact_percentiles, value_counts

FLAG_ORDER = (
    ("POTENTIAL_DUPLICATE", "is_near_repeat"),
    ("SUSPICIOUS_FARE", "is_suspicious"),
    ("UNMAPPED_LOCATION", "is_unmapped"),
    ("UNKNOWN_AIRLINE", "is_unknown_airline"),
    ("MISSING_OPTIONAL_FIELD", "lacks_optional"),
    ("STALE_OBSERVATION", "is_stale"),
    ("UNUSUAL_BOOKING_HORIZON", "is_unusual_horizon"),
)


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def _clean(name: str, upper: bool = True) -> Column:
    text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.upper(text) if upper else text


def prepare(df: DataFrame) -> DataFrame:
    """Trimmed and parsed helper columns next to the raw ones."""
    work = df.withColumns(
        {
            "flight_day": C.as_date(df, "flight_date"),
            "booking_day": C.as_date(df, "booking_date"),
            "fare": C.as_number(F.col("total_fare")),
            "origin_code": _clean("origin"),
            "destination_code": _clean("destination"),
            "currency_code": _clean("currency"),
            "airline_name": _clean("airline", upper=False),
            "id_key": _clean("observation_id", upper=False),
        }
    )
    return work.withColumns(
        {
            "route": F.concat_ws("-", "origin_code", "destination_code"),
            "horizon_days": F.datediff("flight_day", "booking_day"),
        }
    )


def field_reason(config: QualityConfig) -> Column:
    """The first of the twelve field rules that a prepared row breaks."""
    code = r"^[A-Z]{3}$"
    blank = lambda name: C.is_blank(F.col(name))
    return C.first_reason(
        [
            ("MISSING_OBSERVATION_ID", blank("observation_id")),
            ("MISSING_AIRLINE", blank("airline")),
            ("MISSING_ORIGIN", blank("origin")),
            ("MISSING_DESTINATION", blank("destination")),
            ("INVALID_AIRPORT_CODE", ~F.col("origin_code").rlike(code) | ~F.col("destination_code").rlike(code)),
            ("SAME_ORIGIN_DESTINATION", F.col("origin_code") == F.col("destination_code")),
            ("INVALID_FLIGHT_DATE", F.col("flight_day").isNull()),
            ("INVALID_BOOKING_DATE", F.col("booking_day").isNull()),
            ("NEGATIVE_BOOKING_HORIZON", F.col("horizon_days") < 0),
            ("MISSING_CURRENCY", blank("currency")),
            ("NON_INR_CURRENCY", ~F.col("currency_code").isin(*config.allowed_currencies)),
            ("NON_POSITIVE_FARE", F.col("fare").isNull() | (F.col("fare") <= 0)),
        ]
    )


def is_stale(df: DataFrame, config: QualityConfig, newest: Column) -> Column:
    if "timestamp" not in df.columns:
        return F.lit(False)
    return older(C.as_instant(df, "timestamp"), config, newest)


def older(seen_at: Column, config: QualityConfig, newest: Column) -> Column:
    age = F.unix_micros(newest) - F.unix_micros(seen_at)
    return F.coalesce(age > F.lit(config.stale_after_days * 86_400_000_000), F.lit(False))


def row_flags(df: DataFrame, config: QualityConfig, newest: Column) -> DataFrame:
    """Flags that need only the row itself and the reference time `newest`."""
    airports = [a[0] for a in AIRPORTS]
    optional = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    lacks = C.any_of(C.is_blank(F.col(c)) for c in optional) if optional else F.lit(False)
    return df.withColumns(
        {
            "is_unmapped": ~F.col("origin_code").isin(airports) | ~F.col("destination_code").isin(airports),
            "is_unknown_airline": ~F.upper("airline_name").isin(*KNOWN_AIRLINES),
            "lacks_optional": lacks,
            "is_stale": is_stale(df, config, newest),
            "is_unusual_horizon": F.coalesce(F.col("horizon_days") > config.unusual_horizon_days, F.lit(False)),
        }
    )


def newest_timestamp(df: DataFrame) -> Column:
    """The latest timestamp of all rows, rejected ones too, as a scalar subquery."""
    if "timestamp" not in df.columns:
        return F.lit(None).cast("timestamp")
    return df.select(C.as_instant(df, "timestamp").alias("ts")).agg(F.max("ts").alias("ts")).scalar()


def _mad_limits(counts: DataFrame, key: str, config: QualityConfig) -> DataFrame:
    """(key, total, lo, hi): median +- multiplier * 1.4826 * MAD; lo and hi null when the MAD is 0."""
    middle = stage(exact_percentiles(counts, [key], {"center": 0.5}, "fare"), "fare-centers")
    away = counts.join(middle.withColumnRenamed("total", "size"), key)
    away = away.withColumn("deviation", F.abs(F.col("fare") - F.col("center")))
    spread = exact_percentiles(value_counts(away, [key], "deviation", "n"), [key], {"mad": 0.5}, "deviation")
    both = middle.join(spread.drop("total"), key)
    margin = F.lit(config.sanity_mad_multiplier) * (F.lit(1.4826) * F.col("mad"))
    usable = F.col("mad") != 0
    return both.select(
        key,
        "total",
        F.when(usable, F.col("center") - margin).alias("lo"),
        F.when(usable, F.col("center") + margin).alias("hi"),
    )


def mark_suspicious(candidates: DataFrame, config: QualityConfig) -> DataFrame:
    """Add `is_suspicious` to candidates: far from the route's median, or from the batch's for thin routes.

    A route with enough fares but no spread is never flagged. Routes and the batch as a whole are
    two keys of the same count table, so both limits come from one pass.
    """
    per_route = value_counts(candidates, ["route"], "fare", "copies")
    batch = per_route.withColumn("route", F.lit("*")).groupBy("route", "bin", "fare").agg(F.sum("n").alias("n"))
    counts = stage(per_route.unionByName(batch), "route-fare-counts")
    limits = stage(_mad_limits(counts, "route", config), "fare-limits")
    whole = limits.filter((F.col("route") == "*") & (F.col("total") >= config.sanity_min_group))
    batch_lo, batch_hi = whole.select("lo").scalar(), whole.select("hi").scalar()
    own = F.col("total") >= config.sanity_min_group
    bounds = limits.filter(F.col("route") != "*").select(
        "route",
        F.when(own, F.col("lo")).otherwise(batch_lo).alias("fare_lo"),
        F.when(own, F.col("hi")).otherwise(batch_hi).alias("fare_hi"),
    )
    joined = candidates.join(bounds, "route", "left")
    outside = (F.col("fare") < F.col("fare_lo")) | (F.col("fare") > F.col("fare_hi"))
    return joined.withColumn("is_suspicious", F.coalesce(outside, F.lit(False))).drop("fare_lo", "fare_hi")


NARROW = (
    "row_key", "content_key", "group_key", "observation_id", "total_fare", "rejection_reason", "route", "flight_day",
    "horizon_days", "is_unmapped", "is_unknown_airline", "lacks_optional", "is_unusual_horizon", "is_complete",
)
JUDGED = (
    "row_key", "observation_id", "route", "flight_day", "horizon_days", "fare", "rejection_reason", "flag_reasons",
    "status", "copies", "is_complete",
)


def verdicts(
    df: DataFrame,
    config: QualityConfig = QualityConfig(),
    reference_time: Column | None = None,
    order_cols: tuple[str, ...] = ORDER_COLS,
) -> DataFrame:
    """Every distinct row's key with reason, flags, status and `copies`, in narrow columns.

    All checks run on keys of fixed size and on what the row alone decides, so what is shuffled and staged doesn't grow with
    the width of the rows. `source` and `timestamp` (parsed) stay where the rows have them. The surplus copies of an
    otherwise good row come as a second row with reason EXACT_DUPLICATE.
    """
    carried = {"source": F.col("source")} if "source" in df.columns else {}
    if "timestamp" in df.columns:
        carried["timestamp"] = F.col("seen_at")
    return _judged(df, config, reference_time, order_cols).select(*JUDGED, *[c.alias(n) for n, c in carried.items()])


def _judged(
    df: DataFrame,
    config: QualityConfig,
    reference_time: Column | None,
    order_cols: tuple[str, ...],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """`verdicts` with the raw columns named in `keep` carried along.

    Rows are shuffled by content and staged, then those candidates by id that share one; the fare counts and the near search read candidates only.
    Rejected rows are in a branch of their own without flags, so a reader of one kind of rows, or of no flags, doesn't run the
    searches for others.
    """
    raw = df.columns
    source = ["source"] if "source" in raw else []
    seen_at = ["seen_at"] if "timestamp" in raw else []
    work = prepare(df).withColumns({"rejection_reason": field_reason(config), **row_keys(raw)})
    good = F.col("rejection_reason").isNull()
    unaged = F.lit(None).cast("timestamp")  # the age needs the newest row and follows from the staged table
    work = row_flags(work, config, unaged).withColumn("is_complete", is_complete(df, config))
    work = work.withColumn("group_key", F.when(good, F.col("group_key")))
    if seen_at:
        work = work.withColumn("seen_at", C.as_instant(df, "timestamp"))
    order = row_order(work.columns, order_cols)
    narrow = list(dict.fromkeys([*NARROW, *order, *source, *seen_at]))
    extra = [c for c in keep if c not in narrow]
    rows = stage(distinct_rows(work.select(*narrow, *extra), order, extra), "graded-rows")
    checked, shuffled = mark_exact(rows, order)
    if shuffled and not extra:  # wide rows are rather dealt by id again than written once more
        checked = stage(checked, "graded-candidates")
    fare = C.as_number(F.col("total_fare"))
    rows, checked = rows.withColumn("fare", fare), checked.withColumn("fare", fare)
    repeat = F.col("is_repeat")
    surplus = F.when(repeat, F.col("copies")).otherwise(F.col("copies") - 1)
    again = checked.withColumns({"copies": surplus, "rejection_reason": F.lit("EXACT_DUPLICATE")}).filter(F.col("copies") > 0)
    rejected = rows.filter(~good).drop("later_of_content").unionByName(again.drop("is_repeat"))
    rejected = rejected.withColumn("flag_reasons", F.array().cast("array<string>"))

    stale = F.lit(False)
    if seen_at:
        newest = reference_time if reference_time is not None else rows.agg(F.max("seen_at").alias("ts")).scalar()
        stale = older(F.col("seen_at"), config, newest)
    # survivors differ in their ids, so the order needs nothing beyond them
    upto = F.struct(*order[: order.index("observation_id") + 1])
    unique = checked.filter(~repeat).drop("is_repeat").withColumns(
        {"copies": F.lit(1).cast("long"), "rejection_reason": F.lit(None).cast("string"), "row_order": upto, "is_stale": stale}
    )
    # in this order, so that the fare counts read the staged rows and not the near search
    flagged = mark_near(mark_suspicious(unique, config), config)
    flags = C.in_order([(code, F.col(test)) for code, test in FLAG_ORDER])
    flagged = flagged.withColumn("flag_reasons", flags)
    return _with_status(flagged.select(*rejected.columns)).unionByName(_with_status(rejected))


def grade(
    df: DataFrame,
    config: QualityConfig = QualityConfig(),
    reference_time: Column | None = None,
    order_cols: tuple[str, ...] = ORDER_COLS,
) -> DataFrame:
    """Every row with reason, flags and status, identical rows as one row with `copies` (see `verdicts`).

    The input is read once: raw columns go along with the keys into the staged rows.
    """
    if missing_columns(df):
        return _schema_failure(df)
    raw = df.columns
    added = ("route", "flight_day", "horizon_days", "fare", "rejection_reason", "flag_reasons", "status", "copies")
    return _judged(df, config, reference_time, order_cols, tuple(raw)).select(*raw, *added)


def _with_status(df: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("rejection_reason").isNotNull(), "REJECTED")
        .when(F.size("flag_reasons") > 0, "FLAGGED")
        .otherwise("VALID")
    )
    return df.withColumn("status", status)


def _schema_failure(df: DataFrame) -> DataFrame:
    """A required column is missing: every row is rejected, none is dropped."""
    out = df.withColumns(
        {
            "rejection_reason": F.lit("INVALID_SCHEMA"),
            "flag_reasons": F.array().cast("array<string>"),
            "copies": F.lit(1).cast("long"),
        }
    )
    return _with_status(out)


def passthrough(graded: DataFrame, raw_cols: list[str]) -> DataFrame:
    """Rows that flow on (VALID and FLAGGED) in their original values."""
    return graded.filter(F.col("status") != "REJECTED").select(*raw_cols)


def record_results(graded: DataFrame) -> DataFrame:
    return graded.select("observation_id", "status", "rejection_reason", "flag_reasons", "copies")


# --- Batch figures -----------------------------------------------------------------------------


def _lacking(df: DataFrame) -> tuple[Column, Column]:
    """Whether a row lacks a required and an optional field."""
    present = [c for c in REQUIRED_COLUMNS if c in df.columns]
    optional = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    no_required = F.lit(True) if missing_columns(df) else C.any_of(C.is_blank(F.col(c)) for c in present)
    return no_required, C.any_of(C.is_blank(F.col(c)) for c in optional) if optional else F.lit(True)


def is_complete(df: DataFrame, config: QualityConfig) -> Column:
    no_required, no_optional = _lacking(df)
    return ~no_required & ~no_optional if config.strict_completeness else ~no_required


def completeness(df: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row: how many raw rows carry all required and all optional fields."""
    no_required, no_optional = _lacking(df)
    out = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~no_required).alias("records_with_all_required_fields"),
        F.count_if(no_required).alias("records_missing_required_fields"),
        F.count_if(no_optional).alias("records_missing_optional_fields"),
        F.count_if(is_complete(df, config)).alias("complete"),
    )
    rate = F.coalesce(F.try_divide("complete", "total_records"), F.lit(0.0))
    return out.withColumn("completeness_rate", rate).drop("complete")


def reason_counts(graded: DataFrame) -> DataFrame:
    """(kind, reason, n) for rejections and flags; a row counts once per flag."""
    rejected = graded.filter(F.col("status") == "REJECTED").groupBy(F.col("rejection_reason").alias("reason"))
    flagged = graded.select(F.explode("flag_reasons").alias("reason"), "copies").groupBy("reason")
    return (
        rejected.agg(F.sum("copies").alias("n"))
        .withColumn("kind", F.lit("rejection"))
        .unionByName(flagged.agg(F.sum("copies").alias("n")).withColumn("kind", F.lit("flag")))
    )


def batch_rates(graded: DataFrame) -> DataFrame:
    """One row of counts and rates. FLAGGED rows do not count as valid here, yet they flow on."""

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("copies"))), F.lit(0))

    status = F.col("status")
    out = graded.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("records_received"),
        rows(status == "VALID").alias("records_valid"),
        rows(status == "FLAGGED").alias("records_flagged"),
        rows(status == "REJECTED").alias("records_rejected"),
        rows(F.col("rejection_reason") == "EXACT_DUPLICATE").alias("exact_duplicate_count"),
        rows(F.array_contains("flag_reasons", "POTENTIAL_DUPLICATE")).alias("potential_duplicate_count"),
        F.coalesce(F.max(F.when(F.col("rejection_reason") == "INVALID_SCHEMA", 0.0)), F.lit(1.0)).alias(
            "schema_compliance_rate"
        ),
        *([rows(F.col("is_complete")).alias("complete")] if "is_complete" in graded.columns else []),
    )

    def share(name: str) -> Column:
        return F.coalesce(F.try_divide(name, "records_received"), F.lit(0.0))

    out = out.withColumns(
        {"validity_rate": share("records_valid"), "duplicate_rate": share("exact_duplicate_count")}
    )
    return out.withColumn("completeness_rate", share("complete")).drop("complete") if "complete" in out.columns else out


def quality_score(rates: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Score and grade from columns completeness_rate, validity_rate, duplicate_rate,
    schema_compliance_rate and source_success_rate (null counts as 1)."""
    w = [F.lit(x) for x in config.score_weights]
    score = 100.0 * (
        w[0] * F.col("completeness_rate")
        + w[1] * F.col("validity_rate")
        + w[2] * (1.0 - F.col("duplicate_rate"))
        + w[3] * F.col("schema_compliance_rate")
        + w[4] * F.coalesce("source_success_rate", F.lit(1.0))
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    grade_word = C.first_reason([(word, F.col("raw_score") >= floor) for floor, word in config.grade_bands])
    return (
        rates.withColumn("raw_score", bounded)
        .withColumn("quality_grade", grade_word.otherwise("POOR"))
        .withColumn("quality_score", F.round("raw_score", 2))
        .drop("raw_score")
    )


def batch_report(
    df: DataFrame, graded: DataFrame, config: QualityConfig = QualityConfig(), success_rate: Column | None = None
) -> DataFrame:
    """One row with every batch figure. On a schema failure all rates are 0.

    Verdicts know which rows are complete, so that nothing but them is read; of graded rows `df` is read again.
    """
    failed = bool(missing_columns(df))
    success = success_rate if success_rate is not None else F.lit(None).cast("double")
    rates = batch_rates(graded).withColumn("source_success_rate", success)
    if failed:
        rates = rates.withColumn("completeness_rate", F.lit(0.0))
    elif "completeness_rate" not in rates.columns:
        rates = rates.withColumn("completeness_rate", completeness(df, config).select("completeness_rate").scalar())
    if failed:
        # The duplicate share enters the score as one minus the rate, which is 0 here as well.
        rates = rates.withColumn("schema_compliance_rate", F.lit(0.0))
    return quality_score(rates, config)


def letter_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    )


def health_word(rate: Column) -> Column:
    return F.when(rate >= 0.9, "healthy").when(rate >= 0.6, "degraded").otherwise("critical")
