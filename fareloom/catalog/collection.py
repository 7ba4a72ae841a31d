"""Collection runs, landed files and fare payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import collection as K
from ..operators import health, indices, quality, ranking
from ..plans.dashboard import dashboard_summary
from ..session import shared_dir, stage, tune
from ..sources import domain_views as V
from ..sources import landed, payloads
from . import quality as Q
from . import traffic as TQ
from . import views as S
from .index import IN_RANGE, price_index, rd

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CALLS = f"WITH calls AS ({S.CALLS}), pr AS (SELECT source, route, bool_or(status = 'SUCCESS') AS ok, sum(CASE WHEN status = 'SUCCESS' THEN n_observations ELSE 0 END) AS n, count(*) FILTER (WHERE status <> 'SUCCESS') AS bad FROM calls GROUP BY 1, 2) "


@query(
    "run_report",
    _CALLS
    + "SELECT source, count(*) AS routes_requested, count(*) FILTER (WHERE ok) AS routes_successful, count(*) FILTER (WHERE NOT ok) AS routes_failed, CAST(sum(n) AS BIGINT) AS observations_collected, CAST(sum(bad) AS BIGINT) AS failed_calls, string_agg(route, ',' ORDER BY route) AS routes_attempted FROM pr GROUP BY 1",
)
def _report(spark, sf):
    rows = health.run_report(V.calls(spark, sf))
    plain = ("source", "routes_requested", "routes_successful", "routes_failed", "observations_collected", "failed_calls")
    return rows.select(*plain, F.array_join("routes_attempted", ",").alias("routes_attempted"))


@query("failure_breakdown", _CALLS + "SELECT source, status, count(*) AS n FROM calls WHERE status <> 'SUCCESS' GROUP BY 1, 2")
def _failures(spark, sf):
    return health.failure_breakdown(V.calls(spark, sf))


@query(
    "overall_success",
    _CALLS + "SELECT count(*) AS routes_requested, count(*) FILTER (WHERE ok) AS routes_successful, count(*) FILTER (WHERE NOT ok) AS routes_failed FROM (SELECT route, bool_or(ok) AS ok FROM pr GROUP BY 1)",
)
def _overall(spark, sf):
    return health.overall_success(V.calls(spark, sf))


@query(
    "request_grid",
    f"""WITH calls AS ({S.CALLS}), r AS (SELECT DISTINCT split_part(route, '-', 1) AS origin, split_part(route, '-', 2) AS destination FROM calls)
    SELECT source, origin, destination, strftime(DATE '2024-01-01' + o, '%Y-%m-%d') AS flight_date FROM r, (SELECT unnest(['site_a', 'site_b']) AS source), (SELECT unnest([1, 5, 11, 22, 45, 61]) AS o)""",
)
def _grid(spark, sf):
    ends = F.split("route", "-")
    routes = V.calls(spark, sf).select(ends[0].alias("origin"), ends[1].alias("destination")).distinct()
    rows = K.request_grid(routes, ["site_a", "site_b"], F.lit("2024-01-01").cast("date"))
    return rows.select("source", "origin", "destination", F.date_format("flight_date", "yyyy-MM-dd").alias("flight_date"))


_ERR = "CASE event_type WHEN 'error' THEN 'ReadTimeout' WHEN 'click' THEN 'RateLimitError' WHEN 'view' THEN 'HttpStatusError' WHEN 'signup' THEN 'ConnectionError' ELSE 'ValueError' END"
_STATUS = f"CASE WHEN contains(lower({_ERR}), 'timeout') THEN 'TIMEOUT' WHEN contains(lower({_ERR}), 'rate') OR contains(props, '429') THEN 'RATE_LIMITED' WHEN contains(lower({_ERR}), 'http') OR contains(lower({_ERR}), 'connection') THEN 'HTTP_ERROR' ELSE 'PARSE_ERROR' END"


@query(
    "classify_failures",
    f"SELECT {_STATUS} AS status, {_STATUS} IN ('TIMEOUT', 'HTTP_ERROR', 'RATE_LIMITED') AS retryable, count(*) AS n FROM events GROUP BY ALL",
)
def _classify(spark, sf):
    kind = F.col("event_type")
    name = (
        F.when(kind == "error", "ReadTimeout").when(kind == "click", "RateLimitError").when(kind == "view", "HttpStatusError")
        .when(kind == "signup", "ConnectionError").otherwise("ValueError")
    )
    rows = V.table(spark, sf, "events").withColumn("status", K.failure_status(name, F.col("props")))
    return rows.groupBy("status", K.is_retryable(F.col("status")).alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stamp_provenance",
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'run_1' END AS run_id, '2024-02-01T00:00:00' AS scraped_at, count(*) AS n FROM events GROUP BY 1""",
)
def _stamp(spark, sf):
    rows = V.table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, "own").alias("run_id"))
    return K.stamp_provenance(rows, "run_1", "2024-02-01T00:00:00").groupBy("run_id", "scraped_at").agg(F.count(F.lit(1)).alias("n"))


@query(
    "simple_observations",
    f"WITH src AS ({S.fares()}) SELECT origin, destination, 'UNKNOWN' AS airline, strftime(flight_date, '%Y-%m-%d') AS flight_date, strftime(flight_date, '%Y-%m-%d') AS booking_date, {S.r('total_fare', 2)} AS total_fare, 'INR' AS currency FROM src",
)
def _simple(spark, sf):
    fares = V.fares(spark, sf)
    rows = K.map_simple_observations(_simple_rows(fares))
    return rows.select("origin", "destination", "airline", "flight_date", "booking_date", rd("total_fare", 2), "currency")


def _simple_rows(fares):
    return fares.select(
        F.concat_ws("-", "origin", "destination").alias("route"),
        F.col("total_fare").alias("fare"),
        F.date_format("flight_date", "yyyy-MM-dd").alias("date"),
        F.lit("real").alias("source"),
    )


@query(
    "simple_observation_ids",
    f"WITH src AS ({S.fares()}) SELECT origin, destination, 2 * count(*) AS n, 2 * count(*) AS ids FROM src GROUP BY 1, 2",
)
def _simple_ids(spark, sf):
    """Every quote twice: equal rows keep ids of their own."""
    simple = _simple_rows(V.fares(spark, sf))
    rows = K.map_simple_observations(simple.unionByName(simple))
    return rows.groupBy("origin", "destination").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("observation_id").alias("ids")
    )


@query("all_mock", "SELECT bool_and(event_id % 2 = 0) AS all_mock FROM events")
def _mock(spark, sf):
    flag = F.when(F.col("event_id") % 2 == 1, F.lit(False))
    return K.all_mock(V.table(spark, sf, "events").select(flag.alias("is_mock")))


# --- Landed files ------------------------------------------------------------------------------

_FILE_SQL = f"WITH src AS ({S.fares_dirty()}) SELECT coalesce(source, '') AS source, count(*) AS n, count(*) FILTER (WHERE coalesce(origin, '') <> '') AS with_origin, {S.r('sum(total_fare)', 2)} AS fare_sum FROM src GROUP BY 1"


def _file_summary(rows):
    return rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("origin", F.lit("")) != "").alias("with_origin"),
        F.round(F.sum("total_fare"), 2).alias("fare_sum"),
    )


@query("read_runs", _FILE_SQL)
def _runs(spark, sf):
    """Round trip: one run directory is written, then read back with the observation schema."""
    target = landed.write_run(V.fares_dirty(spark, sf), folder(spark, "runs"), "run_1")
    return _file_summary(landed.read_runs(spark, [target]))


@query("collection_envelopes", _FILE_SQL)
def _envelopes(spark, sf):
    """Round trip through the files of envelopes, one run per source."""
    rows = V.fares_dirty(spark, sf).withColumn("run_id", F.concat(F.lit("run_"), "source"))
    names = ("source", "routes_requested", "routes_successful", "routes_failed", "routes_attempted")
    per_source = rows.groupBy("run_id", "source").agg(F.collect_set(F.concat_ws("-", "origin", "destination")).alias("r"))
    n = F.size("r").cast("long")
    summary = F.struct(
        F.col("source"), n.alias("routes_requested"), n.alias("routes_successful"), F.lit(0).cast("long").alias("routes_failed"),
        F.col("r").alias("routes_attempted"),
    )
    report = per_source.select("run_id", F.lit("batch").alias("mode"), F.array(summary).alias("source_summaries"))
    assert tuple(f.name for f in report.schema["source_summaries"].dataType.elementType) == names
    target = folder(spark, "envelopes")
    landed.write_envelopes(report, rows, target)
    return _file_summary(landed.read_envelopes(spark, target)["observations"])


@query(
    "read_traffic_csv",
    f'WITH t AS ({S.TRAFFIC}) SELECT "City1" AS city, count(*) AS n, CAST(sum("PaxToCity2") AS DOUBLE) AS pax FROM t GROUP BY 1',
)
def _csv(spark, sf):
    target = folder(spark, "traffic-csv")
    V.traffic(spark, sf).write.csv(target, header=True)
    rows = landed.read_traffic_csv(spark, target)
    return rows.groupBy(F.col("City1").alias("city")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("PaxToCity2").cast("double")).alias("pax")
    )


@query(
    "load_routes",
    TQ.CTES
    + f"""SELECT a.code AS origin_iata, b.code AS destination_iata, rank AS priority, CAST(tier AS BIGINT) AS tier FROM tiers JOIN codes a ON a.city = origin
    JOIN codes b ON b.city = destination WHERE rank <= 100 AND tier IN (1, 2)""",
)
def _routes(spark, sf):
    """Round trip of the recommended-routes document."""
    planned = TQ.coverage.recommended_routes(TQ.tiered(spark, sf), TQ.T.city_map(spark))
    target = folder(spark, "routes")
    landed.write_recommended_routes(planned, F.lit("2001"), target, "TRAFFIC_DERIVED")
    rows = landed.load_routes(spark, target, (1, 2))
    return rows.select(
        "origin_iata", "destination_iata", F.col("priority").cast("long").alias("priority"), F.col("tier").cast("long").alias("tier")
    )


@query(
    "write_route_priority",
    TQ.CTES
    + f"SELECT CAST(rank AS BIGINT) AS priority_rank, origin, destination, CAST(tier AS BIGINT) AS tier, {S.r('w', 8)} AS national_weight FROM tiers WHERE rank <= 150",
)
def _priority(spark, sf):
    target = folder(spark, "priority")
    landed.write_route_priority(TQ.coverage.route_priority(TQ.tiered(spark, sf)), target)
    schema = (
        "priority_rank long, tier long, tier_label string, origin string, destination string, city_pair string, passengers double, "
        "national_weight double, cumulative_coverage double, currently_covered boolean, recommended boolean, "
        "geographic_reason string, source string"
    )
    rows = spark.read.schema(schema).csv(target, header=True)
    return rows.select("priority_rank", "origin", "destination", "tier", rd("national_weight", 8))


# --- Payloads ----------------------------------------------------------------------------------


def _responses(spark, sf):
    """Search responses built from orders: two itineraries per line item, with planted defects."""
    items = V._line_items(spark, sf, "nation")
    k = F.col("l_partkey")
    legs = F.when(
        k % 13 == 0, F.lit("[]")
    ).otherwise(
        F.format_string(
            '[{"airline":"%s","departure_airport":{"time":"%s 10:30"}},{"airline":"X"}]',
            V._airline(), F.date_format("l_shipdate", "yyyy-MM-dd"),
        )
    )
    token = F.when(k % 2 == 0, F.format_string(',"booking_token":"T%d"', k)).otherwise("")
    one = F.format_string('{"flights":%s,"price":%s,"total_duration":95%s}', legs, F.floor(V._fare()).cast("string"), token)
    body = F.format_string('{"best_flights":[%s],"other_flights":[]}', one)
    payload = (
        F.when(k % 17 == 0, '{"error":"quota"}').when(k % 19 == 0, "<html>").when(k % 23 == 0, '{"best_flights":[]}')
        .when(k % 29 == 0, "[1]").when(k % 31 == 0, '{"best_flights":{}}').otherwise(body)
    )
    return items.select(
        "origin", "destination", F.date_format("l_shipdate", "yyyy-MM-dd").alias("flight_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("booking_date"), payload.alias("payload"),
    )


_RESPONSE_STATUS = """CASE WHEN k % 17 = 0 THEN 'SOURCE_UNAVAILABLE' WHEN k % 19 = 0 THEN 'PARSE_ERROR' WHEN k % 23 = 0 THEN 'EMPTY_RESULT'
 WHEN k % 29 = 0 OR k % 31 = 0 THEN 'MALFORMED_RESPONSE' WHEN k % 13 = 0 THEN 'PARSE_ERROR' ELSE 'SUCCESS' END"""
_LI = f"WITH li AS (SELECT *, l_partkey AS k, floor({S._FARE}) AS fare, {S._AIRLINE} AS airline FROM {S._joined('nation')}) "


@query(
    "itinerary_statuses",
    _LI + f"SELECT {_RESPONSE_STATUS} AS status, count(*) AS n FROM li GROUP BY 1",
)
def _statuses(spark, sf):
    return payloads.itinerary_statuses(_responses(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_itineraries",
    _LI
    + f"""SELECT 'serpapi_' || origin || '_' || destination || '_' || strftime(l_shipdate, '%Y-%m-%d') || '_' || CASE WHEN k % 2 = 0 THEN 'T' || k
    ELSE airline || '_' || printf('%.1f', fare) END AS observation_id, airline, fare + 0.0 AS total_fare, CAST(1 AS BIGINT) AS stops, CAST(95 AS DOUBLE) AS duration
    FROM li WHERE {_RESPONSE_STATUS} = 'SUCCESS'""",
)
def _itineraries(spark, sf):
    rows = payloads.parse_itineraries(_responses(spark, sf))
    return rows.select("observation_id", "airline", "total_fare", F.col("stops").cast("long").alias("stops"), "duration")


def _calendars(spark, sf):
    items = V._line_items(spark, sf, "nation")
    k = F.col("l_partkey")
    code = V.pick(("6E", "AI", "SG", "QP", "IX", "HR"), k % 6)
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    entry = (
        F.when(k % 11 == 0, "{}").when(k % 13 == 0, '{"lf":null,"la":"6E"}')
        .otherwise(F.format_string('{"lf":%s,"la":"%s"}', F.floor(V._fare()).cast("string"), code))
    )
    asked = F.when(k % 7 == 0, "2030-01-01").otherwise(day)
    payload = F.when(k % 17 == 0, "{}").otherwise(F.format_string('{"ld":"%s","day":{"%s":%s}}', day, day, entry))
    return items.select(
        "origin", "destination", asked.alias("flight_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("booking_date"),
        payload.alias("payload"),
    )


_CAL_STATUS = "CASE WHEN k % 17 = 0 THEN 'MALFORMED_RESPONSE' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'EMPTY_RESULT' WHEN k % 13 = 0 THEN 'PARSE_ERROR' ELSE 'SUCCESS' END"


@query("calendar_statuses", _LI + f"SELECT {_CAL_STATUS} AS status, count(*) AS n FROM li GROUP BY 1")
def _calendar_statuses(spark, sf):
    return payloads.calendar_statuses(_calendars(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_fare_calendar",
    _LI
    + f"""SELECT 'yatra_' || origin || '_' || destination || '_' || strftime(l_shipdate, '%Y-%m-%d') || '_' || ['6E', 'AI', 'SG', 'QP', 'IX', 'HR'][k % 6 + 1] || '_lowest' AS observation_id,
    ['IndiGo', 'Air India', 'SpiceJet', 'Akasa Air', 'Air India Express', 'HR'][k % 6 + 1] AS airline, fare + 0.0 AS total_fare, 'LOWEST_OF_DAY' AS fare_type FROM li WHERE {_CAL_STATUS} = 'SUCCESS'""",
)
def _calendar(spark, sf):
    rows = payloads.parse_fare_calendar(_calendars(spark, sf))
    return rows.select("observation_id", "airline", "total_fare", "fare_type")


# --- Dashboard ---------------------------------------------------------------------------------


_LISTED = "string_agg(CASE WHEN {test} THEN route END, ',' ORDER BY {rank})"


@query(
    "dashboard_summary",
    S.index_ctes()
    + f""", m AS (SELECT period, route, mom, row_number() OVER (PARTITION BY period ORDER BY mom DESC NULLS LAST, route) AS up,
      row_number() OVER (PARTITION BY period ORDER BY mom ASC NULLS LAST, route) AS down,
      row_number() OVER (PARTITION BY period ORDER BY points DESC NULLS LAST, route) AS gain FROM inflation {IN_RANGE}),
    lists AS (SELECT period, {_LISTED.format(test="up <= 3 AND mom IS NOT NULL", rank="up")} AS top_increases,
      {_LISTED.format(test="down <= 3 AND mom IS NOT NULL", rank="down")} AS top_decreases, {_LISTED.format(test="gain <= 3", rank="gain")} AS top_contributors
      FROM m GROUP BY 1),
    cov AS (SELECT period, count(*) AS total_routes, count(*) FILTER (WHERE status = 'OK') AS active_routes,
      coalesce({S.r("avg(CASE WHEN status = 'OK' THEN coalesce(wn, 0) END)", 4)}, 0) AS average_coverage FROM inflation {IN_RANGE} GROUP BY 1),
    q AS ({Q.SQL["batch_report"]})
    SELECT n.period, {S.r('idx')} AS national_index, {S.r('mom')} AS mom_change_pct, {S.r('yoy')} AS yoy_change_pct, total_routes, active_routes,
      average_coverage, {S.r('q.quality_score / 100', 4)} AS quality_score, q.letter AS quality_grade, CASE WHEN c.period IS NOT NULL THEN 'real' ELSE 'synthetic' END AS data_source,
      coalesce(top_increases, '') AS top_increases, coalesce(top_decreases, '') AS top_decreases, coalesce(top_contributors, '') AS top_contributors
    FROM (SELECT * FROM national {IN_RANGE}) n LEFT JOIN lists l ON l.period = n.period LEFT JOIN cov c ON c.period = n.period, q""",
)
def _dashboard(spark, sf):
    index = price_index(spark, sf)
    inflation = stage(index.inflation(), "inflation")
    raw = V.fares_dirty(spark, sf)
    report = quality.batch_report(raw, Q.grade(spark, sf))
    rows = dashboard_summary(index.national(), indices.route_listing(inflation, "real"), inflation, report, F.lit(True))
    rounded = ("national_index", "mom_change_pct", "yoy_change_pct")
    lists = ("top_increases", "top_decreases", "top_contributors")
    routes = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["route"]), ","), F.lit("")).alias(c)
    return rows.select(*[rd(c) if c in rounded else c for c in rows.columns if c not in lists], *[routes(c) for c in lists])


@query(
    "letter_grades",
    "SELECT CASE WHEN q >= 90 THEN 'A' WHEN q >= 80 THEN 'B' WHEN q >= 70 THEN 'C' WHEN q >= 60 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM (SELECT value * 4 AS q FROM events) GROUP BY 1",
)
def _letters(spark, sf):
    grade = quality.letter_grade(F.col("value") * 4)
    return V.table(spark, sf, "events").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query("sorted_routes", S.index_ctes(S.fares("nation")) + f"SELECT route, {S.r('yoy')} AS yoy_inflation_pct FROM inflation WHERE month_ord = {S.CURRENT_ORD}")
def _sorted(spark, sf):
    rows = price_index(spark, sf, "nation").inflation(S.CURRENT, S.CURRENT).select("route", rd("yoy_inflation_pct"))
    return ranking.sort_nulls_last(rows, "yoy_inflation_pct")
