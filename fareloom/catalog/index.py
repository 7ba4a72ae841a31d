"""Index, contribution, volatility and ranking queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..config import IndexConfig, VolatilityConfig
from ..functions import columns as C
from ..operators import affordability as aff
from ..operators import cleaning, collection, facts, indices, ranking, traffic, validation, volatility, weights
from ..operators.quantiles import exact_percentiles, trimmed_means
from ..plans import comparisons
from ..plans.price_index import PriceIndex
from ..sources import domain_views as V
from ..session import tune
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


def rd(name: str, digits: int = 6, out: str | None = None):
    return F.round(F.col(name), digits).alias(out or name)


def price_index(spark, sf, level="region", weights=None, **options) -> PriceIndex:
    return PriceIndex(V.fares(spark, sf, level), IndexConfig(S.BASE, **options), weights)


NATIONAL = ("period", "national_index", "mom_change_pct", "yoy_change_pct", "routes_covered", "routes_total",
            "coverage_rate", "observations_used")
NATIONAL_SQL = (
    f"SELECT period, {S.r('idx')} AS national_index, {S.r('mom')} AS mom_change_pct, {S.r('yoy')} AS yoy_change_pct,"
    f" routes_covered, routes_total, {S.r('coverage')} AS coverage_rate, obs AS observations_used FROM national"
)
IN_RANGE = " WHERE month_ord >= (SELECT lo FROM first_month)"


def national_rows(df):
    rounded = {"national_index", "mom_change_pct", "yoy_change_pct", "coverage_rate"}
    return df.select(*[rd(c) if c in rounded else F.col(c) for c in NATIONAL])


def _national(spark, sf, level="region", **options):
    return national_rows(price_index(spark, sf, level, **options).national())


query("national_index", S.index_ctes() + NATIONAL_SQL + IN_RANGE)(_national)
query("national_index_nations", S.index_ctes(S.fares("nation")) + NATIONAL_SQL + IN_RANGE)(
    partial(_national, level="nation")
)
for _method in ("mad", "percentile", "none"):
    query(f"national_index_outlier_{_method}", S.index_ctes(outlier=_method) + NATIONAL_SQL + IN_RANGE)(
        partial(_national, outlier_method=_method)
    )
for _rep in ("mean", "trimmed_mean"):
    query(f"national_index_{_rep}", S.index_ctes(rep=_rep) + NATIONAL_SQL + IN_RANGE)(
        partial(_national, representative_method=_rep)
    )
query("national_index_geometric", S.index_ctes(agg="geometric") + NATIONAL_SQL + IN_RANGE)(
    partial(_national, aggregation_method="geometric")
)
query("national_index_horizon", S.index_ctes(horizon="15-30") + NATIONAL_SQL + IN_RANGE)(
    partial(_national, booking_horizon_filter="15-30")
)

# --- Rows --------------------------------------------------------------------------------------


@query(
    "validate_observations",
    f"WITH src AS ({S.fares_dirty()}), checked AS ({S.CHECKED}) SELECT coalesce(rejection_reason, 'VALID') AS reason,"
    f" count(*) AS n, {S.r('sum(total_fare)', 2)} AS fare_sum FROM checked GROUP BY 1",
)
def _validate(spark, sf):
    checked = validation.with_rejection_reason(V.fares_dirty(spark, sf))
    return checked.groupBy(F.coalesce("rejection_reason", F.lit("VALID")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("total_fare"), 2).alias("fare_sum")
    )


@query(
    "rejected_observations",
    f"WITH src AS ({S.fares_dirty()}), checked AS ({S.CHECKED}) SELECT observation_id, origin, destination,"
    " rejection_reason FROM checked WHERE rejection_reason IS NOT NULL",
)
def _rejected(spark, sf):
    _, rejected = validation.validate(V.fares_dirty(spark, sf))
    return rejected.select("observation_id", "origin", "destination", "rejection_reason")


@query(
    "enriched_observations",
    S.index_ctes() + f"SELECT observation_id, route, {S.period('month_ord')} AS period, days AS booking_horizon_days,"
    f" bucket AS booking_horizon_bucket, {S.r('fare', 2)} AS standardized_fare FROM enriched",
)
def _enriched(spark, sf):
    valid, _ = validation.validate(V.fares(spark, sf))
    rows = validation.enrich(valid, IndexConfig(S.BASE))
    days = F.col("booking_horizon_days").cast("long").alias("booking_horizon_days")
    return rows.select(
        "observation_id", "route", "period", days, "booking_horizon_bucket", rd("standardized_fare", 2)
    )


@query(
    "horizon_filter",
    S.index_ctes(horizon="31-60") + "SELECT route, count(*) AS n FROM enriched GROUP BY route",
)
def _horizon(spark, sf):
    rows = price_index(spark, sf, booking_horizon_filter="31-60").enriched
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_duplicates",
    f"""WITH src AS ({S.fares_dirty()}), checked AS ({S.CHECKED}), good AS (SELECT * FROM checked WHERE rejection_reason IS NULL)
    SELECT observation_id, {S.r('fare', 2)} AS total_fare, copies FROM (SELECT observation_id, min(total_fare) AS fare,
    count(*) AS copies FROM good GROUP BY 1)""",
)
def _dedup(spark, sf):
    valid, _ = validation.validate(V.fares_dirty(spark, sf))
    slim = valid.select("observation_id", "total_fare", "flight_date")
    return cleaning.first_per_key(slim, ["observation_id"], count_as="copies").select(
        "observation_id", rd("total_fare", 2), "copies"
    )


_FLAG_SQL = f"SELECT route, {S.period('month_ord')} AS period, count(*) AS n, {S.r('min(fare)', 2)} AS lowest FROM flagged WHERE is_outlier GROUP BY 1, 2"
for _method in ("iqr", "mad", "percentile"):

    def _outliers(spark, sf, method):
        flagged = price_index(spark, sf, outlier_method=method).flagged.filter("is_outlier")
        return flagged.groupBy("route", C.period_text(F.col("month_ord")).alias("period")).agg(
            F.sum("n").alias("n"), F.round(F.min("standardized_fare"), 2).alias("lowest")
        )

    query(f"outliers_{_method}", S.index_ctes(outlier=_method) + _FLAG_SQL)(partial(_outliers, method=_method))


@query(
    "cleaning_report",
    S.index_ctes()
    + """, reasons AS (SELECT rejection_reason AS reason, count(*) AS n FROM checked WHERE rejection_reason IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'DUPLICATE', (SELECT count(*) FROM enriched) - (SELECT count(*) FROM uniq)
    UNION ALL SELECT 'OUTLIER_IQR', count(*) FROM flagged WHERE is_outlier
    UNION ALL SELECT 'received', count(*) FROM checked UNION ALL SELECT 'valid', count(*) FROM kept
    UNION ALL SELECT 'removed', (SELECT count(*) FROM checked) - (SELECT count(*) FROM kept))
    SELECT reason, n FROM reasons WHERE n > 0""",
)
def _report(spark, sf):
    return price_index(spark, sf).cleaning_report().select("reason", F.col("n").cast("long").alias("n"))


# --- Aggregates --------------------------------------------------------------------------------

_FACT_SQL = (
    f"SELECT route, {S.period('month_ord')} AS period, {S.r('fare', 7)} AS representative_fare, n AS observations_used,"
    " ok_n AS sufficient FROM facts"
)


def _facts(spark, sf, **options):
    rows = price_index(spark, sf, "nation", **options).facts
    return rows.select("route", "period", rd("representative_fare", 7), "observations_used", "sufficient")


query("route_period_fares", S.index_ctes(S.fares("nation")) + _FACT_SQL)(_facts)
query("route_period_fares_mean", S.index_ctes(S.fares("nation"), rep="mean") + _FACT_SQL)(
    partial(_facts, representative_method="mean")
)


def _region_facts(spark, sf, **options):
    rows = price_index(spark, sf, **options).facts
    return rows.select("route", "period", rd("representative_fare", 7), "observations_used", "sufficient")


query("route_period_fares_trimmed", S.index_ctes(rep="trimmed_mean") + _FACT_SQL)(
    partial(_region_facts, representative_method="trimmed_mean")
)

# --- Indices -----------------------------------------------------------------------------------


@query(
    "route_indices",
    S.index_ctes(S.fares("nation"))
    + f"SELECT route, period, {S.r('base_fare', 4)} AS base_period_fare, {S.r('fare', 4)} AS period_fare,"
    f" {S.r('idx')} AS route_index, n AS observations_used, {S.r('wn', 8)} AS weight_normalized, status FROM routes"
    f" WHERE month_ord BETWEEN {S.CURRENT_ORD - 2} AND {S.CURRENT_ORD}",
)
def _routes(spark, sf):
    rows = price_index(spark, sf, "nation").routes(C.shift_period(S.CURRENT, -2), S.CURRENT)
    return rows.select(
        "route", "period", rd("base_period_fare", 4), rd("period_fare", 4), rd("route_index"),
        "observations_used", rd("weight_normalized", 8), "status",
    )


@query(
    "route_status_counts",
    S.index_ctes(S.fares("nation"))
    + "SELECT period, status, count(*) AS n FROM routes WHERE month_ord >= (SELECT lo FROM first_month) GROUP BY 1, 2",
)
def _statuses(spark, sf):
    return price_index(spark, sf, "nation").routes().groupBy("period", "status").agg(F.count(F.lit(1)).alias("n"))


_EFFECTIVE = """SELECT o AS origin, d AS destination, CAST(w AS DOUBLE) AS weight, f AS effective_from, t AS effective_to,
 'TABLE' AS source FROM (SELECT split_part(route, '-', 1) AS o, split_part(route, '-', 2) AS d, 1 + n_o AS w,
 CASE WHEN n_o % 3 = 0 THEN DATE '1995-06-15' END AS f, CASE WHEN n_o % 2 = 0 THEN DATE '1997-03-01' END AS t FROM pairs)"""
_PAIRS = f"""pairs AS (SELECT {S.array(S.NATION_CODES)}[a.n_nationkey + 1] || '-' || {S.array(S.NATION_CODES)}[b.n_nationkey + 1] AS route,
 a.n_nationkey AS n_o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"""


def effective_weights(spark, sf):
    """Pairs of nations of one region with a validity range."""
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    pairs = n.join(b, "n_regionkey").filter(F.col("n_nationkey") != F.col("b"))
    k = F.col("n_nationkey")
    return pairs.select(
        V.pick(V.NATION_CODES, k).alias("origin"),
        V.pick(V.NATION_CODES, F.col("b")).alias("destination"),
        (k + 1).cast("double").alias("weight"),
        F.when(k % 3 == 0, F.lit("1995-06-15").cast("date")).alias("effective_from"),
        F.when(k % 2 == 0, F.lit("1997-03-01").cast("date")).alias("effective_to"),
        F.lit("TABLE").alias("source"),
    )


@query(
    "weights_for_period",
    f"WITH {_PAIRS}, ew AS ({_EFFECTIVE}) SELECT origin || '-' || destination AS route, weight,"
    f" {S.r('weight / sum(weight) OVER ()', 8)} AS weight_normalized FROM ew WHERE (effective_from IS NULL OR effective_from <= DATE '{S.BASE}-01')"
    f" AND (effective_to IS NULL OR effective_to >= DATE '{S.BASE}-01')",
)
def _weights(spark, sf):
    rows = weights.normalize(weights.weights_for_period(effective_weights(spark, sf), S.BASE))
    return rows.select("route", "weight", rd("weight_normalized", 8))


_VERSIONED = f"""SELECT o AS origin, d AS destination, v, CASE WHEN v > 0 THEN DATE '1996-01-01' + to_days((n * v * 97)::INT) END::DATE AS f,
 CASE WHEN v < 3 THEN DATE '1996-01-01' + to_days((n * (v + 1) * 97 - CASE WHEN n % 4 = 0 THEN 0 ELSE 1 END)::INT) END::DATE AS t
 FROM (SELECT split_part(route, '-', 1) AS o, split_part(route, '-', 2) AS d, n_o + 1 AS n, v FROM pairs, (SELECT unnest([0, 1, 2, 3]) AS v))"""


@query(
    "overlapping_weights",
    f"""WITH {_PAIRS}, ew AS ({_VERSIONED}) SELECT b.origin || '-' || b.destination AS route, CAST(b.f AS VARCHAR) AS effective_from,
    CAST(max(coalesce(a.t, DATE '9999-12-31')) AS VARCHAR) AS taken_until FROM ew a JOIN ew b ON a.origin = b.origin AND a.destination = b.destination AND a.v < b.v
    WHERE coalesce(a.t, DATE '9999-12-31') >= b.f GROUP BY 1, 2""",
)
def _overlaps(spark, sf):
    """Four weights of a route in turn; those of every fourth origin end on the day the next one begins."""
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    pairs = n.join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey").filter("n_nationkey <> b")
    versions = pairs.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("n", F.col("n_nationkey") + 1)
    day = lambda step: F.date_add(F.lit("1996-01-01").cast("date"), step.cast("int"))
    last = F.col("n") * (F.col("v") + 1) * 97 - F.when(F.col("n") % 4 == 0, 0).otherwise(1)
    rows = versions.select(
        V.pick(V.NATION_CODES, F.col("n_nationkey")).alias("origin"), V.pick(V.NATION_CODES, F.col("b")).alias("destination"),
        F.lit(1.0).alias("weight"), F.when(F.col("v") > 0, day(F.col("n") * F.col("v") * 97)).alias("effective_from"),
        F.when(F.col("v") < 3, day(last)).alias("effective_to"),
    )
    text = [F.col(c).cast("string").alias(c) for c in ("effective_from", "taken_until")]
    return weights.overlapping(rows).select("route", *text)


@query(
    "weights_for_periods",
    f"""WITH {_PAIRS}, ew AS ({_EFFECTIVE}), m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders)
    SELECT strftime(d, '%Y-%m') AS period, count(*) AS routes, CAST(sum(weight) AS DOUBLE) AS weight FROM m JOIN ew
    ON (effective_from IS NULL OR effective_from <= d) AND (effective_to IS NULL OR effective_to >= d) GROUP BY 1""",
)
def _weights_many(spark, sf):
    months = V.table(spark, sf, "orders").select(C.month_ord(F.col("o_orderdate")).alias("month_ord")).distinct()
    rows = weights.weights_for_periods(effective_weights(spark, sf), months)
    return rows.groupBy(C.period_text(F.col("month_ord")).alias("period")).agg(
        F.count(F.lit(1)).alias("routes"), F.sum("weight").alias("weight")
    )


@query(
    "metro_weights",
    S.index_ctes(S.fares("nation")) + f"SELECT route, weight, {S.r('wn', 8)} AS weight_normalized FROM w",
)
def _metro(spark, sf):
    routes = validation.add_route(validation.validate(V.fares(spark, sf, "nation"))[0])
    table = weights.normalize(weights.with_defaults(weights.metro_weights(routes)))
    return table.select("route", "weight", rd("weight_normalized", 8))


@query(
    "national_index_table_weights",
    S.index_ctes(
        S.fares("nation"),
        weights=f"SELECT origin || '-' || destination AS route, weight FROM (WITH {_PAIRS} {_EFFECTIVE}) WHERE (effective_from IS NULL"
        f" OR effective_from <= DATE '{S.BASE}-01') AND (effective_to IS NULL OR effective_to >= DATE '{S.BASE}-01')",
    )
    + NATIONAL_SQL
    + IN_RANGE,
)
def _weighted(spark, sf):
    return national_rows(price_index(spark, sf, "nation", effective_weights(spark, sf)).national())


@query(
    "index_summary",
    S.index_ctes()
    + f"""SELECT '{S.BASE}' AS base_period, period, {S.r('idx')} AS national_index, {S.r('mom')} AS mom_change_pct,
    {S.r('yoy')} AS yoy_change_pct, routes_covered, routes_total, routes_with_data, obs AS observations_used,
    {S.r('coverage')} AS coverage_rate, (SELECT count(*) FROM checked) AS observations_received,
    (SELECT count(*) FROM checked) - (SELECT count(*) FROM kept) AS observations_rejected,
    (SELECT count(*) FROM flagged WHERE is_outlier) AS outliers_flagged, 'median' AS representative_method,
    'arithmetic' AS aggregation_method FROM national WHERE month_ord = {S.CURRENT_ORD}""",
)
def _summary(spark, sf):
    row = price_index(spark, sf).summary(S.CURRENT)
    rounded = ("national_index", "mom_change_pct", "yoy_change_pct", "coverage_rate")
    counts = ("observations_received", "observations_rejected", "outliers_flagged")
    plain = ("base_period", "period", "routes_covered", "routes_total", "routes_with_data", "observations_used",
             "representative_method", "aggregation_method")
    return row.select(*plain, *[rd(c) for c in rounded], *[F.col(c).cast("long").alias(c) for c in counts])


_LISTS = (("no_base_data", "NO_BASE_DATA"), ("insufficient_data", "INSUFFICIENT_DATA"), ("new_route", "NEW_ROUTE"),
          ("discontinued", "DISCONTINUED"))


@query(
    "quality_flag_lists",
    S.index_ctes(S.fares("nation"))
    + "SELECT period, "
    + ", ".join(
        f"coalesce(string_agg(CASE WHEN status = '{status}' THEN route END, ',' ORDER BY route), '') AS routes_{name}"
        for name, status in _LISTS
    )
    + f" FROM routes WHERE month_ord BETWEEN {S.CURRENT_ORD - 2} AND {S.CURRENT_ORD} GROUP BY period",
)
def _flag_lists(spark, sf):
    rows = price_index(spark, sf, "nation").national(C.shift_period(S.CURRENT, -2), S.CURRENT)
    return rows.select("period", *[F.array_join(f"routes_{n}", ",").alias(f"routes_{n}") for n, _ in _LISTS])


@query(
    "composition_change",
    S.index_ctes(S.fares("nation"))
    + """SELECT period, count(*) FILTER (WHERE (idx IS NOT NULL) <> (idx1 IS NOT NULL)) AS changed_mom,
    count(*) FILTER (WHERE (idx IS NOT NULL) <> (idx12 IS NOT NULL)) AS changed_yoy,
    coalesce(string_agg(CASE WHEN (idx IS NOT NULL) <> (idx1 IS NOT NULL) THEN route END, ',' ORDER BY route), '') AS routes_mom
    FROM routes"""
    + IN_RANGE
    + " GROUP BY period",
)
def _composition(spark, sf):
    rows = price_index(spark, sf, "nation").national()
    return rows.select(
        "period",
        F.size("routes_changed_mom").cast("long").alias("changed_mom"),
        F.size("routes_changed_yoy").cast("long").alias("changed_yoy"),
        F.array_join("routes_changed_mom", ",").alias("routes_mom"),
    )


@query(
    "coverage_rate",
    S.index_ctes(S.fares("nation")) + f"SELECT period, {S.r('coverage')} AS coverage_rate FROM national" + IN_RANGE,
)
def _coverage(spark, sf):
    rows = price_index(spark, sf, "nation").routes()
    return rows.groupBy("period").agg(F.round(indices.coverage_rate(), 6).alias("coverage_rate"))


# --- Changes and contributions -----------------------------------------------------------------


@query(
    "route_inflation",
    S.index_ctes()
    + f"""SELECT route, period, {S.r('idx')} AS current_index, {S.r('mom')} AS mom_inflation_pct, {S.r('yoy')} AS yoy_inflation_pct,
    {S.r('wn')} AS weight, {S.r('points')} AS contribution, {S.r('cv')} AS volatility, status FROM inflation"""
    + IN_RANGE,
)
def _inflation(spark, sf):
    rows = price_index(spark, sf).inflation()
    values = ("current_index", "mom_inflation_pct", "yoy_inflation_pct", "weight", "contribution", "volatility")
    return rows.select("route", "period", *[rd(c) for c in values], "status")


@query(
    "contributions",
    S.index_ctes()
    + f"""SELECT period, row_number() OVER (PARTITION BY period ORDER BY round(abs(points), 9) DESC NULLS LAST, route) AS rank, route,
    {S.r('cw')} AS contribution_weight, {S.r('points')} AS contribution_points FROM contrib_points"""
    .replace("contrib_points", "(SELECT *, cw * (idx - idx1) AS points FROM contrib)")
    + IN_RANGE,
)
def _contributions(spark, sf):
    index = price_index(spark, sf)
    rows = indices.ranked_contributions(index.routes(), index.config)
    return rows.select(
        "period", F.col("rank").cast("long").alias("rank"), "route", rd("contribution_weight"), rd("contribution_points")
    )


@query(
    "contributions_geometric",
    S.index_ctes()
    + f"SELECT period, route, {S.r('cw * (ln(idx) - ln(idx1)) * 100')} AS contribution_points FROM contrib"
    + IN_RANGE,
)
def _contributions_geo(spark, sf):
    rows = price_index(spark, sf, aggregation_method="geometric").contributions()
    return rows.select("period", "route", rd("contribution_points"))


@query(
    "contribution_sums",
    S.index_ctes()
    + f"""SELECT a.period, {S.r('total')} AS points, {S.r('n.idx - p.idx')} AS index_change FROM (SELECT period, month_ord,
    sum(points) AS total, count(*) FILTER (WHERE (idx IS NULL) <> (idx1 IS NULL)) AS moved FROM inflation GROUP BY 1, 2) a
    JOIN national n ON n.month_ord = a.month_ord JOIN national p ON p.month_ord = a.month_ord - 1
    WHERE moved = 0 AND a.month_ord > (SELECT lo FROM first_month)""",
)
def _contribution_sums(spark, sf):
    """The points of a month sum to the index change while the usable routes stay the same."""
    index = price_index(spark, sf)
    rows = indices.contributions(index.routes(), index.config)
    moved = F.col("route_index").isNull() != F.col("route_index_prev_month").isNull()
    monthly = rows.groupBy("month_ord", "period").agg(
        F.sum("contribution_points").alias("points"),
        F.count_if(moved).alias("moved"),
        indices.national_value("arithmetic").alias("idx"),
    )
    monthly = monthly.withColumn("before", indices.calendar_lag("idx", 1))
    kept = monthly.filter((F.col("moved") == 0) & F.col("before").isNotNull())
    return kept.select("period", rd("points"), F.round(F.col("idx") - F.col("before"), 6).alias("index_change"))


@query(
    "contribution_breakdown",
    S.index_ctes()
    + f"""SELECT period, route, CASE WHEN points > 0 THEN 'positive' WHEN points < 0 THEN 'negative' ELSE 'zero' END AS side,
    {S.r('points')} AS contribution, {S.r('max(abs(points)) OVER (PARTITION BY period)')} AS scale,
    row_number() OVER (PARTITION BY period ORDER BY abs(points) DESC, route) AS rank FROM inflation WHERE points IS NOT NULL
    AND month_ord >= (SELECT lo FROM first_month)""",
)
def _breakdown(spark, sf):
    rows = ranking.contribution_breakdown(price_index(spark, sf).inflation())
    return rows.select("period", "route", "side", rd("contribution"), rd("scale"), F.col("rank").cast("long").alias("rank"))


# --- Volatility --------------------------------------------------------------------------------

_CLASS = "CASE WHEN {v} IS NULL THEN 'INSUFFICIENT_DATA' WHEN {v} < 0.1 THEN 'LOW' WHEN {v} > 0.25 THEN 'HIGH' ELSE 'MODERATE' END"
_CV = "CASE WHEN n >= 3 THEN sd / nullif(mean, 0) END"


@query(
    "route_volatility",
    S.index_ctes(S.fares("nation"))
    + f"SELECT route, {S.period('month_ord')} AS period, {S.r(_CV)} AS volatility, {_CLASS.format(v='(' + _CV + ')')} AS classification,"
    " n AS observations_used FROM facts",
)
def _route_vol(spark, sf):
    rows = price_index(spark, sf, "nation").route_volatility()
    period = C.period_text(F.col("month_ord")).alias("period")
    return rows.select("route", period, rd("volatility"), "classification", "observations_used")


_RV = f"rv AS (SELECT route, month_ord, n, {_CV} AS v FROM facts), rvw AS (SELECT rv.*, coalesce(wn, 0) AS wn FROM rv LEFT JOIN w USING (route))"


@query(
    "national_volatility",
    S.index_ctes(S.fares("nation"))
    + f""", {_RV}, nv AS (SELECT month_ord, coalesce(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN wn END) <> 0 THEN
    sum(v * wn) / sum(CASE WHEN v IS NOT NULL THEN wn END) END, avg(v)) AS v,
    coalesce(string_agg(CASE WHEN v > 0.25 THEN route END, ',' ORDER BY route), '') AS high_routes,
    coalesce(string_agg(CASE WHEN v < 0.1 THEN route END, ',' ORDER BY route), '') AS low_routes,
    CAST(sum(n) AS BIGINT) AS observations_used FROM rvw GROUP BY 1)
    SELECT {S.period('month_ord')} AS period, {S.r('v')} AS national_volatility, {_CLASS.format(v='v')} AS classification,
    high_routes, low_routes, observations_used FROM nv""",
)
def _national_vol(spark, sf):
    index = price_index(spark, sf, "nation")
    table = weights.normalize(weights.with_defaults(weights.metro_weights(index.counts)))
    rows = volatility.national_volatility(index.route_volatility(), VolatilityConfig(), table)
    return rows.select(
        C.period_text(F.col("month_ord")).alias("period"),
        rd("national_volatility"),
        F.col("national_classification").alias("classification"),
        F.array_join("high_volatility_routes", ",").alias("high_routes"),
        F.array_join("low_volatility_routes", ",").alias("low_routes"),
        "observations_used",
    )


@query(
    "horizon_volatility",
    S.index_ctes()
    + f""", hv AS (SELECT month_ord, bucket, count(*) AS n, avg(fare) AS mean, stddev_samp(fare) AS sd FROM kept GROUP BY 1, 2)
    SELECT {S.period('month_ord')} AS period, bucket AS booking_horizon_bucket, {S.r(_CV)} AS volatility,
    {_CLASS.format(v='(' + _CV + ')')} AS classification, n AS observations_used FROM hv""",
)
def _horizon_vol(spark, sf):
    rows = volatility.horizon_volatility(price_index(spark, sf).kept, VolatilityConfig())
    period = C.period_text(F.col("month_ord")).alias("period")
    return rows.select(period, "booking_horizon_bucket", rd("volatility"), "classification", "observations_used")


@query(
    "log_return_stddev",
    S.index_ctes(S.fares("nation"))
    + f""", ret AS (SELECT route, ln(fare / lag(fare) OVER (PARTITION BY route ORDER BY month_ord)) AS x FROM facts WHERE fare IS NOT NULL)
    SELECT route, {S.r('CASE WHEN count(x) = 1 THEN max(abs(x)) ELSE stddev_samp(x) END')} AS volatility, count(x) AS returns
    FROM ret GROUP BY route""",
)
def _log_returns(spark, sf):
    rows = volatility.log_return_stddev(price_index(spark, sf, "nation").facts)
    return rows.select("route", rd("volatility"), "returns")


# --- Rankings and views ------------------------------------------------------------------------


@query(
    "top_rankings",
    S.index_ctes()
    + ", long AS ("
    + " UNION ALL ".join(
        f"SELECT period, month_ord, route, '{name}' AS list, {col} AS v, {'-' if down else ''}({col}) AS o FROM inflation WHERE {col} IS NOT NULL"
        for name, col, down in (
            ("highest_mom_inflation", "mom", True), ("lowest_mom_inflation", "mom", False),
            ("highest_yoy_inflation", "yoy", True), ("lowest_yoy_inflation", "yoy", False),
            ("largest_positive_contributors", "points", True), ("largest_negative_contributors", "points", False),
            ("highest_volatility", "cv", True),
        )
    )
    + f""") SELECT period, list, rank, route, {S.r('v')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY period, list
    ORDER BY o, route) AS rank FROM long WHERE month_ord >= (SELECT lo FROM first_month)) WHERE rank <= 5""",
)
def _rankings(spark, sf):
    rows = ranking.top_rankings(price_index(spark, sf).inflation())
    return rows.select("period", "list", F.col("rank").cast("long").alias("rank"), "route", rd("value"))


@query(
    "movers",
    S.index_ctes()
    + f""", m AS (SELECT period, route, mom, points, row_number() OVER (PARTITION BY period ORDER BY mom DESC NULLS LAST, route) AS up,
    row_number() OVER (PARTITION BY period ORDER BY mom ASC NULLS LAST, route) AS down,
    row_number() OVER (PARTITION BY period ORDER BY points DESC NULLS LAST, route) AS gain FROM inflation {IN_RANGE})
    SELECT period, 'increase' AS list, up AS rank, {S.r('mom')} AS value, route FROM m WHERE up <= 3 AND mom IS NOT NULL
    UNION ALL SELECT period, 'decrease', down, {S.r('mom')}, route FROM m WHERE down <= 3 AND mom IS NOT NULL
    UNION ALL SELECT period, 'contributor', gain, {S.r('points')}, route FROM m WHERE gain <= 3""",
)
def _movers(spark, sf):
    rows = ranking.movers(price_index(spark, sf).inflation())
    return rows.select("period", "list", F.col("rank").cast("long").alias("rank"), rd("value"), "route")


@query(
    "inflation_matrix",
    S.index_ctes()
    + "SELECT split_part(route, '-', 1) AS origin, "
    + ", ".join(f"{S.r(f'''max(CASE WHEN split_part(route, '-', 2) = '{c}' THEN mom END)''', 2)} AS {c}" for c in sorted(S.REGION_CODES))
    + f" FROM inflation WHERE month_ord = {S.CURRENT_ORD} GROUP BY 1",
)
def _matrix(spark, sf):
    rows = price_index(spark, sf).inflation(S.CURRENT, S.CURRENT)
    matrix = indices.inflation_matrix(rows, list(V.REGION_CODES))
    return matrix.select("origin", *[rd(c, 2) for c in sorted(V.REGION_CODES)])


@query(
    "route_listing",
    S.index_ctes(S.fares("nation"))
    + f"""SELECT period, route, {S.r('idx')} AS route_index, {S.r('mom', 2)} AS mom, {S.r('coalesce(wn, 0)')} AS weight,
    CASE status WHEN 'OK' THEN 'active' WHEN 'NEW_ROUTE' THEN 'new' ELSE 'inactive' END AS status, 'real' AS data_source
    FROM inflation WHERE month_ord = {S.CURRENT_ORD}""",
)
def _listing(spark, sf):
    rows = indices.route_listing(price_index(spark, sf, "nation").inflation(S.CURRENT, S.CURRENT), "real")
    return rows.select("period", "route", rd("route_index"), "mom", rd("weight"), "status", "data_source")


@query(
    "dashboard_coverage",
    S.index_ctes(S.fares("nation"))
    + f"""SELECT period, count(*) AS total_routes, count(*) FILTER (WHERE status = 'OK') AS active_routes,
    coalesce({S.r("avg(CASE WHEN status = 'OK' THEN coalesce(wn, 0) END)", 4)}, 0) AS average_coverage FROM inflation {IN_RANGE} GROUP BY 1""",
)
def _dash_coverage(spark, sf):
    listing = indices.route_listing(price_index(spark, sf, "nation").inflation(), "real")
    return ranking.dashboard_coverage(listing)


@query(
    "map_objects",
    S.index_ctes(S.fares("nation"))
    + f"""SELECT split_part(route, '-', 1) AS origin, split_part(route, '-', 2) AS destination, CAST(a.lat AS DOUBLE) AS origin_lat,
    CAST(b.lon AS DOUBLE) AS destination_lon, {S.r('mom')} AS inflation_mom, {S.r('cv')} AS volatility, status FROM inflation
    JOIN {S.airports_values()} a ON a.code = split_part(route, '-', 1) JOIN {S.airports_values()} b ON b.code = split_part(route, '-', 2)
    WHERE month_ord = {S.CURRENT_ORD}""",
)
def _map(spark, sf):
    rows = price_index(spark, sf, "nation").inflation(S.CURRENT, S.CURRENT)
    objects = ranking.map_objects(rows, ranking.airports(spark))
    return objects.select(
        "origin", "destination", "origin_lat", "destination_lon", rd("inflation_mom"), rd("volatility"), "status"
    )


@query(
    "page",
    S.index_ctes()
    + f"""SELECT period, {S.r('idx')} AS national_index, (SELECT count(*) FROM national {IN_RANGE}) AS total, true AS has_more FROM national
    {IN_RANGE} ORDER BY period LIMIT 10 OFFSET 20""",
)
def _page(spark, sf):
    rows = ranking.page(price_index(spark, sf).national().select("period", rd("national_index")), 10, 20)
    return rows


@query(
    "max_abs",
    S.index_ctes() + f"SELECT period, coalesce({S.r('max(abs(mom))')}, 1) AS max_abs FROM inflation {IN_RANGE} GROUP BY 1",
)
def _max_abs(spark, sf):
    return ranking.max_abs(price_index(spark, sf).inflation(), "mom_inflation_pct").select("period", rd("max_abs"))


# --- Income ------------------------------------------------------------------------------------

_INCOME = """income AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS indicator,
 floor(avg(o_totalprice) * 100) / 100 / 1000 AS value FROM orders GROUP BY 1, 2)"""


def income(spark, sf):
    grouped = V.table(spark, sf, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("indicator")
    )
    return grouped.agg((F.floor(F.avg("o_totalprice") * 100) / 100 / 1000).alias("value"))


@query(
    "affordability",
    S.index_ctes()
    + f""", {_INCOME} SELECT n.period, '1-URGENT' AS indicator, {S.r('idx', 4)} AS airfare_index,
    {S.r('CASE WHEN idx IS NOT NULL AND value <> 0 THEN value END', 6)} AS income_index,
    {S.r('idx / nullif(value, 0) * 100', 4)} AS relative_affordability,
    CASE WHEN idx IS NOT NULL AND coalesce(value, 0) <> 0 THEN 'OK' ELSE 'DATA_UNAVAILABLE' END AS status FROM national n
    LEFT JOIN (SELECT * FROM income WHERE indicator = '1-URGENT') i USING (period)"""
    + IN_RANGE,
)
def _affordability(spark, sf):
    rows = aff.affordability(price_index(spark, sf).national(), income(spark, sf), "1-URGENT")
    return rows.select(
        "period", "indicator", rd("airfare_index", 4), rd("income_index", 6), rd("relative_affordability", 4), "status"
    )


# --- Comparisons -------------------------------------------------------------------------------

_TRAFFIC_W = f"SELECT origin || '-' || destination AS route, w AS weight FROM (SELECT origin, destination, sum(q) AS w FROM (SELECT {S.array(S.REGION_CODES)}[ns.n_regionkey + 1] AS origin, {S.array(S.REGION_CODES)}[nc.n_regionkey + 1] AS destination, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey) GROUP BY 1, 2) WHERE origin <> destination"


def quantity_weights(spark, sf):
    """Weights by shipped quantity between regions."""
    items = V._line_items(spark, sf, "region").select("origin", "destination", "l_quantity")
    return (
        items.filter(F.col("origin") != F.col("destination"))
        .groupBy("origin", "destination")
        .agg(F.sum("l_quantity").alias("weight"))
    )


def _method_sql(m: comparisons.Method) -> str:
    weights_sql = {"metro": None, "traffic": _TRAFFIC_W}.get(
        m.weights, "SELECT route, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT route FROM facts)"
    )
    ctes = S.index_ctes(
        outlier=m.outliers, rep=m.representative, agg=m.aggregation, horizon=m.horizon, weights=weights_sql
    )
    return f"(SELECT * FROM ({ctes} SELECT '{m.label}' AS label, idx, routes_covered, coverage FROM national WHERE month_ord = {S.CURRENT_ORD}))"


@query(
    "sensitivity",
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT * FROM {_method_sql(m)}" for m in comparisons.METHODS)
    + f""") SELECT label, {S.r('idx')} AS national_index, routes_covered, {S.r('coverage')} AS coverage_rate,
    {S.r("idx - (SELECT idx FROM m WHERE label = 'median+iqr')")} AS delta, {S.r('max(idx) OVER () - min(idx) OVER ()')} AS spread FROM m""",
)
def _sensitivity(spark, sf):
    rows = comparisons.sensitivity(V.fares(spark, sf), S.BASE, S.CURRENT, quantity_weights(spark, sf))
    return rows.select(
        "label", rd("national_index"), "routes_covered", rd("coverage_rate"), rd("delta"), rd("spread")
    )


# --- Records around the index ------------------------------------------------------------------


@query(
    "observed_routes",
    f"WITH src AS ({S.fares('nation')}) SELECT DISTINCT origin, destination FROM src",
)
def _observed(spark, sf):
    return collection.observed_routes(V.fares(spark, sf, "nation"))


@query(
    "available_periods",
    f"WITH src AS ({S.fares()}) SELECT DISTINCT strftime(flight_date, '%Y-%m') AS period FROM src",
)
def _periods(spark, sf):
    return collection.available_periods(V.fares(spark, sf))
