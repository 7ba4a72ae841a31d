"""Passenger traffic, weights derived from it and coverage planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METROS, TRUNK_CITIES
from ..operators import coverage, ranking
from ..operators import traffic as T
from ..plans import comparisons
from ..session import tune
from ..sources import domain_views as V
from . import views as S
from .index import price_index, rd

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# Records with planted defects: the same table again with some fields spoiled.
_SPOILED = f"""SELECT CASE WHEN h = 1 THEN 1800 ELSE "Year" END AS "Year", CASE WHEN h = 2 THEN 13 ELSE "Month" END AS "Month",
 CASE WHEN h = 3 THEN ' ' ELSE "City1" END AS "City1", CASE WHEN h = 4 THEN lower("City1") ELSE "City2" END AS "City2",
 CASE WHEN h = 5 THEN -1 ELSE "PaxToCity2" END AS "PaxToCity2", "PaxFromCity2" FROM (SELECT *, ("Year" + "Month" + length("City1") + length("City2")) % 8 AS h FROM ({S.TRAFFIC}))"""


def spoiled(spark, sf):
    df = V.traffic(spark, sf)
    h = (F.col("Year") + F.col("Month") + F.length("City1") + F.length("City2")) % 8
    return df.withColumn("h", h).select(
        F.when(F.col("h") == 1, 1800).otherwise(F.col("Year")).alias("Year"),
        F.when(F.col("h") == 2, 13).otherwise(F.col("Month")).alias("Month"),
        F.when(F.col("h") == 3, " ").otherwise(F.col("City1")).alias("City1"),
        F.when(F.col("h") == 4, F.lower("City1")).otherwise(F.col("City2")).alias("City2"),
        F.when(F.col("h") == 5, -1.0).otherwise(F.col("PaxToCity2")).alias("PaxToCity2"),
        "PaxFromCity2",
    )


CTES = f"""WITH raw AS ({S.TRAFFIC}), valid AS (SELECT * FROM raw WHERE "City1" <> "City2"),
directed AS (SELECT "Year" * 12 + "Month" AS m, "City1" AS origin, "City2" AS destination, "PaxToCity2" AS pax FROM valid
  UNION ALL SELECT "Year" * 12 + "Month", "City2", "City1", "PaxFromCity2" FROM valid),
pairs AS (SELECT origin, destination, sum(pax) AS passengers FROM directed WHERE m > (SELECT max(m) - 12 FROM directed) GROUP BY 1, 2),
nat AS (SELECT *, passengers / sum(passengers) OVER () AS w FROM pairs),
ranked AS (SELECT *, row_number() OVER (ORDER BY w DESC, origin, destination) AS rank,
  sum(w) OVER (ORDER BY w DESC, origin, destination ROWS UNBOUNDED PRECEDING) AS cum FROM nat),
codes AS {S.airports_values()},
obs AS (SELECT DISTINCT a.city AS origin, b.city AS destination FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN codes a ON a.code = {S.array(S.NATION_CODES)}[s_nationkey + 1] JOIN codes b ON b.code = {S.array(S.NATION_CODES)}[c_nationkey + 1]),
covered AS (SELECT nat.*, w / sum(w) OVER () AS cw FROM nat JOIN obs USING (origin, destination)),
tiers AS (SELECT ranked.*, CASE WHEN rank <= 20 THEN 1 WHEN rank <= 50 THEN 2 WHEN rank <= 100 THEN 3 ELSE 4 END AS tier,
  EXISTS (SELECT 1 FROM obs o WHERE o.origin = ranked.origin AND o.destination = ranked.destination) AS covered FROM ranked)
"""


def national(spark, sf):
    directed = T.to_directional(T.validate_traffic(V.traffic(spark, sf)), "TRAFFIC")
    last = T.latest_month(directed)
    return T.national_weights(T.aggregate(directed, last - 11, last))


def ranked(spark, sf):
    return coverage.rank_routes(national(spark, sf))


def covered_codes(spark, sf):
    """Nation code pairs with a quote in any month: the covered routes."""
    return V._line_items(spark, sf, "nation").select("origin", "destination").distinct()


def covered_pairs(spark, sf):
    return T.to_city_pairs(covered_codes(spark, sf), T.city_map(spark))


def tiered(spark, sf):
    return coverage.assign_tiers(coverage.mark_covered(ranked(spark, sf), covered_pairs(spark, sf)))


@query(
    "validate_traffic",
    f"""WITH spoiled AS ({_SPOILED}), c AS (SELECT *, CASE WHEN trim("City1") = '' OR trim("City2") = '' THEN 'MISSING_CITY'
    WHEN upper(trim("City1")) = upper(trim("City2")) THEN 'SAME_ORIGIN_DESTINATION' WHEN "Month" NOT BETWEEN 1 AND 12 THEN 'INVALID_MONTH'
    WHEN "Year" NOT BETWEEN 1990 AND 2100 THEN 'INVALID_YEAR' WHEN "PaxToCity2" < 0 OR "PaxFromCity2" < 0 THEN 'INVALID_PASSENGER_COUNT' END AS reason FROM spoiled)
    SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1""",
)
def _validate(spark, sf):
    return T.rejection_counts(spoiled(spark, sf)).select("reason", F.col("n").cast("long").alias("n"))


@query(
    "directed_traffic",
    CTES + f"SELECT {S.period('m')} AS period, origin, destination, {S.r('pax', 2)} AS passengers FROM directed",
)
def _directed(spark, sf):
    rows = T.to_directional(T.validate_traffic(V.traffic(spark, sf)), "TRAFFIC")
    return rows.select("period", "origin", "destination", rd("passengers", 2))


@query(
    "national_traffic_weights",
    CTES + f"SELECT origin, destination, {S.r('passengers', 2)} AS passengers, {S.r('w', 10)} AS national_weight FROM nat",
)
def _national(spark, sf):
    return national(spark, sf).select("origin", "destination", rd("passengers", 2), rd("national_weight", 10))


@query(
    "covered_subset",
    CTES + f"SELECT origin, destination, {S.r('w', 10)} AS national_weight, {S.r('cw', 10)} AS covered_normalized_weight FROM covered",
)
def _covered(spark, sf):
    rows = T.covered_subset(national(spark, sf), covered_pairs(spark, sf))
    return rows.select("origin", "destination", rd("national_weight", 10), rd("covered_normalized_weight", 10))


@query(
    "traffic_engine_weights",
    CTES
    + f"""SELECT a.code AS origin, b.code AS destination, {S.r('cw', 10)} AS weight, {S.r('w', 10)} AS national_weight,
    {S.period('(SELECT max(m) - 11 FROM directed)')} AS weight_period_start, {S.period('(SELECT max(m) FROM directed)')} AS weight_period_end
    FROM covered JOIN codes a ON a.city = origin JOIN codes b ON b.city = destination""",
)
def _engine(spark, sf):
    rows, _ = T.build_weights(V.traffic(spark, sf), covered_codes(spark, sf))
    return rows.select(
        "origin", "destination", rd("weight", 10), rd("national_weight", 10), "weight_period_start", "weight_period_end"
    )


@query(
    "traffic_diagnostics",
    CTES
    + f"""SELECT count(*) AS total_routes_in_window, {S.r('sum(passengers)', 2)} AS total_passengers_in_window,
    {S.period('(SELECT max(m) - 11 FROM directed)')} AS weight_period_start, (SELECT count(*) FROM covered) AS covered_routes,
    {S.r('(SELECT sum(w) FROM covered)', 8)} AS traffic_weight_coverage, (SELECT count(*) FROM raw) AS records_received,
    (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS records_rejected FROM nat""",
)
def _diagnostics(spark, sf):
    _, row = T.build_weights(V.traffic(spark, sf), covered_codes(spark, sf))
    return row.select(
        "total_routes_in_window", rd("total_passengers_in_window", 2), "weight_period_start", "covered_routes",
        rd("traffic_weight_coverage", 8), "records_received", F.col("records_rejected").cast("long").alias("records_rejected"),
    )


@query(
    "traffic_rejections",
    f"""WITH spoiled AS ({_SPOILED}), twice AS (SELECT * FROM spoiled UNION ALL SELECT * FROM spoiled WHERE "Month" = 5),
    c AS (SELECT *, CASE WHEN trim("City1") = '' OR trim("City2") = '' THEN 'MISSING_CITY'
    WHEN upper(trim("City1")) = upper(trim("City2")) THEN 'SAME_ORIGIN_DESTINATION' WHEN "Month" NOT BETWEEN 1 AND 12 THEN 'INVALID_MONTH'
    WHEN "Year" NOT BETWEEN 1990 AND 2100 THEN 'INVALID_YEAR' WHEN "PaxToCity2" < 0 OR "PaxFromCity2" < 0 THEN 'INVALID_PASSENGER_COUNT' END AS reason FROM twice),
    r AS (SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1 UNION ALL
      SELECT 'DUPLICATE_TRAFFIC_RECORD', sum(x - 1) FROM (SELECT count(*) AS x FROM c WHERE reason IS NULL GROUP BY "Year", "Month", upper(trim("City1")), upper(trim("City2"))))
    SELECT (SELECT count(*) FROM twice) AS records_received, CAST(sum(n) AS BIGINT) AS records_rejected,
    string_agg(reason || ':' || CAST(n AS BIGINT), ',' ORDER BY reason) AS rejection_reasons FROM r""",
)
def _rejections(spark, sf):
    """Diagnostics of records with planted defects and repeats: every reason with its count."""
    rows = spoiled(spark, sf)
    _, row = T.build_weights(rows.unionByName(rows.filter(F.col("Month") == 5)), covered_codes(spark, sf))
    listed = F.transform(F.map_entries("rejection_reasons"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return row.select("records_received", F.col("records_rejected").cast("long").alias("records_rejected"), F.array_join(listed, ",").alias("rejection_reasons"))


_RULE = f"""CASE WHEN a IN {S.names(METROS)} AND b IN {S.names(METROS)} THEN 3.0 ELSE 1.0 END"""
_CODE_PAIRS = f"""(SELECT DISTINCT {S.array(S.NATION_CODES)}[s_nationkey + 1] AS a, {S.array(S.NATION_CODES)}[c_nationkey + 1] AS b FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(
    "traffic_weights_fallback",
    CTES
    + f""", cp AS {_CODE_PAIRS}
    SELECT 'mapped' AS kind, a.code AS origin, b.code AS destination, {S.r('cw', 10)} AS weight, true AS is_real
      FROM covered JOIN codes a ON a.city = origin JOIN codes b ON b.city = destination
    UNION ALL SELECT 'unmapped', a, b, {_RULE}, false FROM (SELECT * FROM cp UNION ALL SELECT 'DEL', 'QQQ')
    UNION ALL SELECT 'uncovered', a, b, {_RULE}, false FROM cp WHERE a = b""",
)
def _fallback(spark, sf):
    """All routes mapped; one code that no city has; only routes within a city, which no traffic covers."""
    raw, routes = V.traffic(spark, sf), covered_codes(spark, sf)
    odd = routes.unionByName(spark.createDataFrame([("DEL", "QQQ")], "origin string, destination string"))
    cases = {"mapped": routes, "unmapped": odd, "uncovered": routes.filter("origin = destination")}
    parts = [T.weights_or_metro(raw, r).select(F.lit(k).alias("kind"), "origin", "destination", rd("weight", 10), "is_real") for k, r in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "ranked_routes",
    CTES + f"SELECT rank, origin, destination, {S.r('w', 8)} AS national_weight, {S.r('cum', 8)} AS cumulative_coverage FROM ranked",
)
def _ranked(spark, sf):
    return ranked(spark, sf).select(
        F.col("rank").cast("long").alias("rank"), "origin", "destination", rd("national_weight", 8), rd("cumulative_coverage", 8)
    )


_NS = (10, 20, 30, 50, 75, 100, 150, 200, 300, 500)


@query(
    "coverage_scenarios",
    CTES
    + f""", c AS (SELECT n AS routes, (SELECT coalesce(sum(w), 0) FROM ranked WHERE rank <= n) AS c FROM (SELECT unnest({list(_NS)}) AS n))
    SELECT CAST(routes AS BIGINT) AS routes, {S.r('c', 8)} AS traffic_coverage, {S.r('c - lag(c, 1, 0.0) OVER (ORDER BY routes)', 8)} AS incremental_gain FROM c""",
)
def _scenarios(spark, sf):
    rows = coverage.coverage_scenarios(ranked(spark, sf), _NS)
    return rows.select(F.col("routes").cast("long").alias("routes"), rd("traffic_coverage", 8), rd("incremental_gain", 8))


_TARGETS = (0.25, 0.5, 0.6, 0.7, 0.8, 0.9)


@query(
    "target_coverage",
    CTES
    + f"""SELECT CAST(t AS DOUBLE) AS target_coverage, (SELECT CAST(min(rank) AS DOUBLE) FROM ranked WHERE cum >= t) AS minimum_routes
    FROM (SELECT unnest({list(_TARGETS)}) AS t)""",
)
def _targets(spark, sf):
    rows = coverage.target_table(ranked(spark, sf), _TARGETS)
    return rows.select("target_coverage", F.col("minimum_routes").cast("double").alias("minimum_routes"))


@query(
    "bidirectional_pairs",
    CTES
    + f"""SELECT city_pair, {S.r('p', 2)} AS passengers, {S.r('w', 8)} AS national_weight, row_number() OVER (ORDER BY p DESC, city_pair) AS rank
    FROM (SELECT least(origin, destination) || ' <-> ' || greatest(origin, destination) AS city_pair, sum(passengers) AS p, sum(w) AS w FROM ranked GROUP BY 1)""",
)
def _bidirectional(spark, sf):
    rows = coverage.bidirectional_summary(national(spark, sf))
    return rows.select("city_pair", rd("passengers", 2), rd("national_weight", 8), F.col("rank").cast("long").alias("rank"))


@query(
    "route_tiers",
    CTES
    + """SELECT origin, destination, rank, CAST(tier AS BIGINT) AS tier, CASE tier WHEN 1 THEN 'TIER 1 - Essential' WHEN 2 THEN 'TIER 2 - High value'
    WHEN 3 THEN 'TIER 3 - Expansion' ELSE 'TIER 4 - Long tail' END AS tier_label, covered AS currently_covered FROM tiers""",
)
def _tiers(spark, sf):
    return tiered(spark, sf).select(
        "origin", "destination", F.col("rank").cast("long").alias("rank"), F.col("tier").cast("long").alias("tier"),
        "tier_label", "currently_covered",
    )


_CITY = """, city AS (SELECT city, sum(passengers) AS p FROM (SELECT origin AS city, passengers FROM nat UNION ALL SELECT destination, passengers FROM nat) GROUP BY 1),
cityr AS (SELECT *, row_number() OVER (ORDER BY p DESC, city) AS rank FROM city)"""


@query("city_traffic", CTES + _CITY + f"SELECT city, {S.r('p', 2)} AS passengers, rank FROM cityr")
def _cities(spark, sf):
    rows = coverage.city_traffic(national(spark, sf))
    return rows.select("city", rd("passengers", 2), F.col("rank").cast("long").alias("rank"))


@query(
    "underrepresented_cities",
    CTES
    + _CITY
    + """SELECT city, rank FROM cityr WHERE rank <= 20 AND city NOT IN (SELECT origin FROM ranked WHERE rank <= 6 UNION SELECT destination FROM ranked WHERE rank <= 6)""",
)
def _gaps(spark, sf):
    pairs = ranked(spark, sf)
    rows = coverage.underrepresented_cities(coverage.city_traffic(pairs), pairs, 20, 6)
    return rows.select("city", F.col("rank").cast("long").alias("rank"))


@query(
    "route_priority",
    CTES
    + f"""SELECT rank AS priority_rank, CAST(tier AS BIGINT) AS tier, origin || ' <-> ' || destination AS city_pair, {S.r('w', 8)} AS national_weight,
    covered AS currently_covered, tier <= 3 AS recommended, CASE WHEN origin IN {S.names(TRUNK_CITIES)} AND destination IN {S.names(TRUNK_CITIES)}
    THEN 'core metro trunk route' ELSE 'high-traffic route' END AS geographic_reason FROM tiers WHERE rank <= 150""",
)
def _priority(spark, sf):
    rows = coverage.route_priority(tiered(spark, sf))
    return rows.select(
        F.col("priority_rank").cast("long").alias("priority_rank"), F.col("tier").cast("long").alias("tier"), "city_pair",
        rd("national_weight", 8), "currently_covered", "recommended", "geographic_reason",
    )


@query(
    "recommended_routes",
    CTES
    + f"""SELECT origin AS origin_city, destination AS destination_city, a.code AS origin_iata, b.code AS destination_iata, rank AS priority,
    CAST(tier AS BIGINT) AS tier, {S.r('w', 8)} AS national_weight, covered AS currently_covered FROM tiers LEFT JOIN codes a ON a.city = origin
    LEFT JOIN codes b ON b.city = destination WHERE rank <= 100""",
)
def _recommended(spark, sf):
    rows = coverage.recommended_routes(tiered(spark, sf), T.city_map(spark))
    return rows.select(
        "origin_city", "destination_city", "origin_iata", "destination_iata", F.col("priority").cast("long").alias("priority"),
        F.col("tier").cast("long").alias("tier"), rd("national_weight", 8), "currently_covered",
    )


# --- Route sets --------------------------------------------------------------------------------

_UNIVERSE = """u AS (SELECT label, a.code || '-' || b.code AS route, w FROM (
 SELECT 'covered' AS label, origin, destination, w FROM covered UNION ALL SELECT 'tier 1', origin, destination, w FROM ranked WHERE rank <= 20
 UNION ALL SELECT 'tier 1+2', origin, destination, w FROM ranked WHERE rank <= 50) JOIN codes a ON a.city = origin JOIN codes b ON b.city = destination)"""


def universes(spark, sf):
    """Covered routes, tier 1 and tiers 1+2 as labelled code pairs."""
    rows = tiered(spark, sf)
    cities = T.city_map(spark)
    o = cities.select(F.col("city").alias("o_city"), F.col("code").alias("o"))
    d = cities.select(F.col("city").alias("d_city"), F.col("code").alias("d"))
    labels = F.array_compact(
        F.array(
            F.when(F.col("currently_covered"), "covered"),
            F.when(F.col("tier") == 1, "tier 1"),
            F.when(F.col("tier") <= 2, "tier 1+2"),
        )
    )
    coded = rows.join(o, F.col("origin") == F.col("o_city")).join(d, F.col("destination") == F.col("d_city"))
    return coded.select(F.explode(labels).alias("label"), F.col("o").alias("origin"), F.col("d").alias("destination"), "national_weight")


_FACTS = S.index_ctes(S.fares("nation"), outlier="iqr")


@query(
    "universe_comparison",
    _FACTS
    + ", "
    + CTES.strip()[len("WITH "):].replace("raw AS", "traffic_raw AS").replace("FROM raw", "FROM traffic_raw")
    + f""", {_UNIVERSE},
    un AS (SELECT u.label, r.month_ord, sum(CASE WHEN idx IS NOT NULL THEN u.w * idx END) / nullif(sum(CASE WHEN idx IS NOT NULL THEN u.w END), 0) AS idx,
      count(*) FILTER (WHERE status = 'OK') AS ok FROM u JOIN routes r USING (route) GROUP BY 1, 2),
    sizes AS (SELECT label, count(*) AS routes, sum(w) AS cov FROM u GROUP BY 1)
    SELECT s.label, routes, {S.r('c.idx')} AS national_index, {S.r('(c.idx / p.idx - 1) * 100')} AS mom_change_pct, c.ok AS routes_covered,
    {S.r('cov', 8)} AS traffic_coverage FROM sizes s LEFT JOIN un c ON c.label = s.label AND c.month_ord = {S.CURRENT_ORD}
    LEFT JOIN un p ON p.label = s.label AND p.month_ord = {S.CURRENT_ORD} - 1""",
)
def _universes(spark, sf):
    rows = comparisons.universe_comparison(price_index(spark, sf, "nation"), universes(spark, sf), S.CURRENT)
    return rows.select(
        "label", "routes", rd("national_index"), rd("mom_change_pct"), "routes_covered", rd("traffic_coverage", 8)
    )


@query(
    "route_detail",
    _FACTS
    + ", "
    + CTES.strip()[len("WITH "):].replace("raw AS", "traffic_raw AS").replace("FROM raw", "FROM traffic_raw")
    + f""", plan AS (SELECT a.code || '-' || b.code AS route, upper(origin[1]) || lower(origin[2:]) AS city, rank, tier FROM tiers
      JOIN codes a ON a.city = origin JOIN codes b ON b.city = destination WHERE rank <= 100)
    SELECT i.route, {S.r('idx')} AS current_index, {S.r('mom')} AS mom_inflation_pct, i.status, CAST(a.lat AS DOUBLE) AS origin_lat,
    CAST(b.lon AS DOUBLE) AS destination_lon, coalesce(plan.city, '') AS origin_city, CAST(coalesce(plan.rank, 0) AS BIGINT) AS priority,
    CASE WHEN f.route IS NULL THEN '' WHEN f.n < 3 THEN 'INSUFFICIENT_DATA' WHEN f.sd / f.mean < 0.1 THEN 'LOW' WHEN f.sd / f.mean > 0.25 THEN 'HIGH'
      ELSE 'MODERATE' END AS volatility_class
    FROM inflation i LEFT JOIN codes a ON a.code = split_part(i.route, '-', 1) LEFT JOIN codes b ON b.code = split_part(i.route, '-', 2)
    LEFT JOIN plan ON plan.route = i.route LEFT JOIN facts f ON f.route = i.route AND f.month_ord = i.month_ord WHERE i.month_ord = {S.CURRENT_ORD}""",
)
def _detail(spark, sf):
    index = price_index(spark, sf, "nation")
    planned = coverage.recommended_routes(tiered(spark, sf), T.city_map(spark))
    inflation = index.inflation(S.CURRENT, S.CURRENT)
    rows = ranking.route_detail(inflation, index.route_volatility(), ranking.airports(spark), planned)
    return rows.select(
        "route", rd("current_index"), rd("mom_inflation_pct"), "status", "origin_lat", "destination_lon",
        F.coalesce("origin_city", F.lit("")).alias("origin_city"),
        F.coalesce("priority", F.lit(0)).cast("long").alias("priority"),
        F.coalesce("volatility_class", F.lit("")).alias("volatility_class"),
    )
