"""Batch grading, duplicates, rates and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import QualityConfig
from ..constants import AIRPORTS, KNOWN_AIRLINES
from ..operators import health, quality
from ..session import tune
from ..sources import domain_views as V
from . import views as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return register


RAW = V.fares_dirty_columns()
CONTENT = [c for c in RAW if c != "observation_id"]
_CONTENT = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in CONTENT)
_BLANK = "trim(coalesce({c}, '')) = ''"
_ORDER = "observation_id, total_fare, " + ", ".join(f"coalesce({c}, '')" for c in CONTENT if c != "total_fare")


def graded_ctes(source: str, ref: str = "(SELECT max(ts) FROM prep)") -> str:
    """The grading as SQL, up to `graded`."""
    b = lambda c: _BLANK.format(c=c)
    return f"""WITH src AS ({source}),
prep AS (SELECT *, upper(trim(coalesce(origin, ''))) AS oc, upper(trim(coalesce(destination, ''))) AS dc,
  upper(trim(coalesce(currency, ''))) AS cc, trim(coalesce(airline, '')) AS an, trim(coalesce(observation_id, '')) AS idk,
  TRY_CAST(flight_date AS DATE) AS fd, TRY_CAST(booking_date AS DATE) AS bd, TRY_CAST("timestamp" AS TIMESTAMP) AS ts,
  {_CONTENT} AS content FROM src),
fields AS (SELECT *, oc || '-' || dc AS route, datediff('day', bd, fd) AS days, CASE
  WHEN {b("observation_id")} THEN 'MISSING_OBSERVATION_ID' WHEN {b("airline")} THEN 'MISSING_AIRLINE'
  WHEN {b("origin")} THEN 'MISSING_ORIGIN' WHEN {b("destination")} THEN 'MISSING_DESTINATION'
  WHEN NOT regexp_matches(oc, '^[A-Z]{{3}}$') OR NOT regexp_matches(dc, '^[A-Z]{{3}}$') THEN 'INVALID_AIRPORT_CODE'
  WHEN oc = dc THEN 'SAME_ORIGIN_DESTINATION' WHEN fd IS NULL THEN 'INVALID_FLIGHT_DATE'
  WHEN bd IS NULL THEN 'INVALID_BOOKING_DATE' WHEN fd < bd THEN 'NEGATIVE_BOOKING_HORIZON'
  WHEN {b("currency")} THEN 'MISSING_CURRENCY' WHEN cc <> 'INR' THEN 'NON_INR_CURRENCY'
  WHEN total_fare IS NULL OR total_fare <= 0 THEN 'NON_POSITIVE_FARE' END AS field_reason,
  row_number() OVER (ORDER BY {_ORDER}) AS pos FROM prep),
firsts AS (SELECT *, CASE WHEN field_reason IS NULL THEN row_number() OVER (PARTITION BY field_reason IS NULL, idk
  ORDER BY observation_id, {"pos"}) END AS by_id, CASE WHEN field_reason IS NULL THEN row_number() OVER
  (PARTITION BY field_reason IS NULL, content ORDER BY observation_id, pos) END AS by_content FROM fields),
settled AS (SELECT *, CASE WHEN field_reason IS NOT NULL THEN field_reason WHEN by_id > 1 OR by_content > 1
  THEN 'EXACT_DUPLICATE' END AS rejection_reason FROM firsts),
good AS (SELECT * FROM settled WHERE rejection_reason IS NULL),
near AS (SELECT DISTINCT a.pos FROM good a JOIN good b ON a.airline = b.airline AND a.origin = b.origin
  AND a.destination = b.destination AND a.flight_date = b.flight_date AND a.booking_date = b.booking_date
  AND a.source = b.source AND b.pos < a.pos
  AND abs(a.total_fare - b.total_fare) <= 0.01::DOUBLE * greatest(abs(b.total_fare), 1e-9)),
dev AS (SELECT route, total_fare AS f, quantile_cont(total_fare, 0.5) OVER (PARTITION BY route) AS m,
  quantile_cont(total_fare, 0.5) OVER () AS bm FROM good),
route_mad AS (SELECT route, count(*) AS n, any_value(m) AS m, quantile_cont(abs(f - m), 0.5) AS mad FROM dev GROUP BY route),
batch AS (SELECT count(*) AS n, any_value(bm) AS m, quantile_cont(abs(f - bm), 0.5) AS mad FROM dev),
lims AS (SELECT route, CASE WHEN r.n >= 5 THEN CASE WHEN r.mad <> 0 THEN r.m - 6.0 * (1.4826 * r.mad) END
    WHEN b.n >= 5 AND b.mad <> 0 THEN b.m - 6.0 * (1.4826 * b.mad) END AS lo,
  CASE WHEN r.n >= 5 THEN CASE WHEN r.mad <> 0 THEN r.m + 6.0 * (1.4826 * r.mad) END
    WHEN b.n >= 5 AND b.mad <> 0 THEN b.m + 6.0 * (1.4826 * b.mad) END AS hi FROM route_mad r, batch b),
flags AS (SELECT s.*, s.rejection_reason IS NULL AS alive, n.pos IS NOT NULL AS f_near,
  coalesce(s.total_fare < l.lo OR s.total_fare > l.hi, false) AS f_fare,
  oc NOT IN {S.names(a[0] for a in AIRPORTS)} OR dc NOT IN {S.names(a[0] for a in AIRPORTS)} AS f_place,
  upper(an) NOT IN {S.names(KNOWN_AIRLINES)} AS f_airline,
  {b('"timestamp"')} OR {b("s.source")} OR {b("fare_class")} AS f_optional,
  coalesce({ref} - ts > INTERVAL 14 DAY, false) AS f_stale, coalesce(days > 330, false) AS f_horizon
  FROM settled s LEFT JOIN near n ON s.pos = n.pos LEFT JOIN lims l ON s.route = l.route),
listed AS (SELECT *, CASE WHEN alive THEN concat_ws(',', CASE WHEN f_near THEN 'POTENTIAL_DUPLICATE' END,
  CASE WHEN f_fare THEN 'SUSPICIOUS_FARE' END, CASE WHEN f_place THEN 'UNMAPPED_LOCATION' END,
  CASE WHEN f_airline THEN 'UNKNOWN_AIRLINE' END, CASE WHEN f_optional THEN 'MISSING_OPTIONAL_FIELD' END,
  CASE WHEN f_stale THEN 'STALE_OBSERVATION' END, CASE WHEN f_horizon THEN 'UNUSUAL_BOOKING_HORIZON' END) ELSE '' END
  AS flags FROM flags),
graded AS (SELECT *, CASE WHEN NOT alive THEN 'REJECTED' WHEN flags <> '' THEN 'FLAGGED' ELSE 'VALID' END AS status FROM listed)
"""


# The grading orders rows by id, then content; the twin numbers the rows by the same columns.
ROW_ORDER = ("observation_id", "total_fare")


def grade(spark, sf, grouped: bool = False):
    """Verdicts of all rows: no query but `passthrough` needs the raw columns."""
    source = V.fares_grouped(spark, sf) if grouped else V.fares_dirty(spark, sf)
    return quality.verdicts(source, order_cols=ROW_ORDER)


DIRTY = graded_ctes(S.fares_dirty())
GROUPED = graded_ctes(S.fares_grouped())


@query(
    "field_reasons",
    DIRTY + "SELECT coalesce(field_reason, 'OK') AS reason, count(*) AS n FROM fields GROUP BY 1",
)
def _fields(spark, sf):
    rows = quality.prepare(V.fares_dirty(spark, sf)).withColumn("r", quality.field_reason(QualityConfig()))
    return rows.groupBy(F.coalesce("r", F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepared_rows",
    DIRTY
    + "SELECT observation_id, route, strftime(fd, '%Y-%m-%d') AS flight_day, CAST(days AS DOUBLE) AS horizon_days FROM fields",
)
def _prepared(spark, sf):
    rows = quality.prepare(V.fares_dirty(spark, sf))
    return rows.select(
        "observation_id",
        "route",
        F.date_format("flight_day", "yyyy-MM-dd").alias("flight_day"),
        F.col("horizon_days").cast("double").alias("horizon_days"),
    )


@query(
    "row_flags",
    DIRTY
    + "SELECT f_place, f_airline, f_optional, f_stale, f_horizon, count(*) AS n FROM flags GROUP BY ALL",
)
def _row_flags(spark, sf):
    rows = quality.prepare(V.fares_dirty(spark, sf))
    flagged = quality.row_flags(rows, QualityConfig(), quality.newest_timestamp(rows))
    return flagged.groupBy(
        F.col("is_unmapped").alias("f_place"),
        F.col("is_unknown_airline").alias("f_airline"),
        F.col("lacks_optional").alias("f_optional"),
        F.col("is_stale").alias("f_stale"),
        F.col("is_unusual_horizon").alias("f_horizon"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "graded_records",
    DIRTY
    + "SELECT observation_id, status, coalesce(rejection_reason, '') AS rejection_reason, flags, count(*) AS copies FROM graded GROUP BY ALL",
)
def _records(spark, sf):
    rows = quality.record_results(grade(spark, sf))
    flags = F.array_join("flag_reasons", ",").alias("flags")
    reason = F.coalesce("rejection_reason", F.lit("")).alias("rejection_reason")
    return rows.groupBy("observation_id", "status", reason, flags).agg(F.sum("copies").alias("copies"))


@query(
    "exact_duplicates",
    DIRTY + "SELECT observation_id, count(*) AS n FROM graded WHERE rejection_reason = 'EXACT_DUPLICATE' GROUP BY 1",
)
def _exact(spark, sf):
    rows = grade(spark, sf).filter(F.col("rejection_reason") == "EXACT_DUPLICATE")
    return rows.groupBy("observation_id").agg(F.sum("copies").alias("n"))


@query(
    "potential_duplicates",
    GROUPED + f"SELECT observation_id, {S.r('total_fare', 2)} AS total_fare FROM graded WHERE f_near",
)
def _near(spark, sf):
    rows = grade(spark, sf, grouped=True).filter(F.array_contains("flag_reasons", "POTENTIAL_DUPLICATE"))
    return rows.select("observation_id", F.round("fare", 2).alias("total_fare"))


@query(
    "suspicious_fares",
    GROUPED + f"SELECT observation_id, route, {S.r('total_fare', 2)} AS total_fare FROM graded WHERE alive AND f_fare",
)
def _suspicious(spark, sf):
    rows = grade(spark, sf, grouped=True).filter(F.array_contains("flag_reasons", "SUSPICIOUS_FARE"))
    return rows.select("observation_id", "route", F.round("fare", 2).alias("total_fare"))


@query(
    "passthrough",
    DIRTY + f"SELECT observation_id, origin, destination, {S.r('total_fare', 2)} AS total_fare FROM graded WHERE status <> 'REJECTED'",
)
def _passthrough(spark, sf):
    graded = quality.grade(V.fares_dirty(spark, sf), order_cols=ROW_ORDER)
    rows = quality.passthrough(graded, RAW)
    return rows.select("observation_id", "origin", "destination", F.round("total_fare", 2).alias("total_fare"))


@query(
    "reason_counts",
    DIRTY
    + """SELECT 'rejection' AS kind, rejection_reason AS reason, count(*) AS n FROM graded WHERE status = 'REJECTED' GROUP BY 2
    UNION ALL SELECT 'flag', unnest(string_split(flags, ',')), count(*) FROM graded WHERE flags <> '' GROUP BY 2""",
)
def _reasons(spark, sf):
    return quality.reason_counts(grade(spark, sf)).select("kind", "reason", "n")


_COMPLETE = """comp AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT nr) AS full_rows, count(*) FILTER (WHERE nr) AS part_rows,
 count(*) FILTER (WHERE no_opt) AS no_optional, count(*) FILTER (WHERE NOT nr AND NOT no_opt) AS strict FROM (SELECT
 """ + " OR ".join(
    f"trim(coalesce(CAST({c} AS VARCHAR), '')) = ''"
    for c in ("observation_id", "airline", "origin", "destination", "flight_date", "booking_date", "total_fare", "currency")
) + """ AS nr, trim(coalesce("timestamp", '')) = '' OR trim(coalesce(source, '')) = '' OR trim(coalesce(fare_class, '')) = '' AS no_opt FROM src))"""


@query(
    "completeness",
    f"WITH src AS ({S.fares_dirty()}), {_COMPLETE} SELECT total AS total_records, full_rows AS records_with_all_required_fields,"
    f" part_rows AS records_missing_required_fields, no_optional AS records_missing_optional_fields, {S.r('full_rows / total')} AS completeness_rate,"
    f" {S.r('strict / total')} AS strict_rate FROM comp",
)
def _completeness(spark, sf):
    df = V.fares_dirty(spark, sf)
    strict = quality.completeness(df, QualityConfig(strict_completeness=True)).select("completeness_rate").scalar()
    row = quality.completeness(df).withColumn("strict_rate", strict)
    rounded = ("completeness_rate", "strict_rate")
    return row.select(*[c for c in row.columns if c not in rounded], *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "batch_report",
    DIRTY
    + f""", {_COMPLETE}, rates AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'VALID') AS v,
    count(*) FILTER (WHERE status = 'FLAGGED') AS f, count(*) FILTER (WHERE status = 'REJECTED') AS x,
    count(*) FILTER (WHERE rejection_reason = 'EXACT_DUPLICATE') AS e FROM graded),
    score AS (SELECT *, 100 * (0.25 * full_rows / total + 0.35 * v / n + 0.15 * (1 - e / n) + 0.10 + 0.15) AS s FROM rates, comp)
    SELECT n AS records_received, v AS records_valid, f AS records_flagged, x AS records_rejected, e AS exact_duplicate_count,
    {S.r('v / n')} AS validity_rate, {S.r('e / n')} AS duplicate_rate, {S.r('full_rows / total')} AS completeness_rate,
    {S.r('s', 2)} AS quality_score, CASE WHEN s >= 95 THEN 'EXCELLENT' WHEN s >= 90 THEN 'GOOD' WHEN s >= 75 THEN 'WARNING' ELSE 'POOR' END
    AS quality_grade, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS letter FROM score""",
)
def _batch(spark, sf):
    row = quality.batch_report(V.fares_dirty(spark, sf), grade(spark, sf))
    rounded = ("validity_rate", "duplicate_rate", "completeness_rate")
    counts = ("records_received", "records_valid", "records_flagged", "records_rejected", "exact_duplicate_count")
    return row.select(
        *counts,
        *[F.round(c, 6).alias(c) for c in rounded],
        "quality_score",
        "quality_grade",
        quality.letter_grade(F.col("quality_score")).alias("letter"),
    )


_FAIL = f"WITH src AS ({S.fares_dirty()}) SELECT count(*) AS records_received, count(*) AS records_rejected, 30.0 AS quality_score, 'POOR' AS quality_grade FROM src"


@query("schema_failure", _FAIL)
def _schema(spark, sf):
    df = V.fares_dirty(spark, sf).drop("currency")
    row = quality.batch_report(df, quality.grade(df))
    return row.select("records_received", "records_rejected", "quality_score", "quality_grade")


ATTEMPTS = f"""attempts AS (SELECT CASE source WHEN 'source_0' THEN 'A' WHEN 'source_1' THEN 'N' WHEN 'source_2' THEN 'R' ELSE source END AS source,
 count(*) AS requested, count(*) FILTER (WHERE ok) AS successful FROM (SELECT source, route, bool_or(status = 'SUCCESS') AS ok
 FROM ({S.CALLS}) GROUP BY 1, 2) GROUP BY 1)"""


def attempts(spark, sf):
    """Attempt log from the calls; three of the sources carry the names of the graded rows."""
    source = F.col("source")
    named = (
        F.when(source == "source_0", "A").when(source == "source_1", "N").when(source == "source_2", "R").otherwise(source)
    )
    return health.run_report(V.calls(spark, sf)).withColumn("source", named)


_REF = "TIMESTAMP '2002-01-01 00:00:00'"
_HEALTH = f""", {ATTEMPTS}, sh AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE status = 'VALID') AS v,
 count(*) FILTER (WHERE status = 'FLAGGED') AS f, count(*) FILTER (WHERE status = 'REJECTED') AS x, max(ts) AS newest FROM graded GROUP BY 1),
 shj AS (SELECT sh.*, requested, successful, successful / nullif(requested, 0) AS rate FROM sh LEFT JOIN attempts USING (source))"""


def _source_health(spark, sf):
    ref = F.lit("2002-01-01 00:00:00").cast("timestamp")
    return health.source_health(grade(spark, sf), attempts(spark, sf), ref)


@query(
    "source_health",
    DIRTY
    + _HEALTH
    + f"""SELECT source, n AS observations_received, v AS valid_observations, f AS flagged_observations, x AS rejected_observations,
    {S.r('v / n')} AS observation_validity_rate, {S.r('rate')} AS route_success_rate, CAST(epoch({_REF} - newest) AS DOUBLE) AS data_age_seconds,
    CASE WHEN rate = 0 THEN 'FAILED' WHEN v / n < 0.85 OR coalesce(rate < 0.8, false) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM shj""",
)
def _sources(spark, sf):
    rows = _source_health(spark, sf)
    return rows.select(
        "source", "observations_received", "valid_observations", "flagged_observations", "rejected_observations",
        F.round("observation_validity_rate", 6).alias("observation_validity_rate"),
        F.round("route_success_rate", 6).alias("route_success_rate"), "data_age_seconds", "status",
    )


@query(
    "route_success_rate",
    DIRTY + _HEALTH + f"SELECT {S.r('sum(rate * requested) / sum(CASE WHEN rate IS NOT NULL THEN requested END)')} AS route_success_rate FROM shj",
)
def _success(spark, sf):
    row = health.route_success_rate(_source_health(spark, sf))
    return row.select(F.round("route_success_rate", 6).alias("route_success_rate"))


@query(
    "route_coverage",
    DIRTY
    + f"""SELECT {S.r("count(*) FILTER (WHERE route IN (SELECT route FROM graded WHERE status <> 'REJECTED')) / count(*)")} AS route_coverage
    FROM (SELECT DISTINCT route FROM ({S.CALLS}))""",
)
def _coverage(spark, sf):
    row = health.route_coverage(grade(spark, sf), attempts(spark, sf))
    return row.select(F.round("route_coverage", 6).alias("route_coverage"))


@query(
    "route_health",
    DIRTY
    + f"""SELECT route, count(*) AS observations_total, count(*) FILTER (WHERE alive) AS observations_valid,
    count(*) FILTER (WHERE NOT alive) AS observations_rejected, {S.r('count(*) FILTER (WHERE alive) / count(*)')} AS route_quality_rate,
    {S.r("count(*) FILTER (WHERE coalesce(rejection_reason, '') NOT IN ('MISSING_OBSERVATION_ID', 'MISSING_AIRLINE', 'MISSING_ORIGIN', 'MISSING_DESTINATION', 'MISSING_CURRENCY')) / count(*)")} AS data_completeness,
    coalesce(bool_or(strftime(fd, '%Y-%m') = '{S.BASE}'), false) AS has_base_period_data, CASE WHEN count(*) FILTER (WHERE alive) / count(*) >= 0.9 THEN 'healthy'
    WHEN count(*) FILTER (WHERE alive) / count(*) >= 0.6 THEN 'degraded' ELSE 'critical' END AS health FROM graded GROUP BY route""",
)
def _routes(spark, sf):
    rows = health.route_health(grade(spark, sf), S.BASE, S.CURRENT)
    return rows.select(
        "route", "observations_total", "observations_valid", "observations_rejected",
        F.round("route_quality_rate", 6).alias("route_quality_rate"),
        F.round("data_completeness", 6).alias("data_completeness"), "has_base_period_data",
        quality.health_word(F.col("route_quality_rate")).alias("health"),
    )
