"""Panels, baseline forecasts, backtests and the comparison with an official series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import IndexConfig
from ..constants import MONTH_NAMES
from ..operators import benchmark, collection, forecast
from ..plans import panel
from ..session import shared_dir, tune
from ..sources import domain_views as V
from ..sources.landed import load_official_series, official_series
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


# --- Series: mean order value per month and priority, with one gap per priority -------------------

_SERIES = """WITH pts AS (SELECT o_orderpriority AS key, year(o_orderdate) * 12 + month(o_orderdate) AS m,
 floor(avg(o_totalprice)) / 100 AS v FROM orders GROUP BY 1, 2),
spine AS (SELECT key, m FROM (SELECT DISTINCT key FROM pts), (SELECT unnest(generate_series(min(m), max(m))) AS m FROM pts)),
ser AS (SELECT key, m, CASE WHEN (m + length(key)) % 11 = 0 THEN NULL ELSE v END AS value,
 row_number() OVER (PARTITION BY key ORDER BY m) AS slot FROM spine LEFT JOIN pts USING (key, m))"""


def order_series(spark, sf):
    day = F.col("o_orderdate").cast("date")
    m = F.year(day) * 12 + F.month(day)
    points = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), m.alias("month_ord"))
    rows = points.agg((F.floor(F.avg("o_totalprice")) / 100).alias("raw"))
    gap = (F.col("month_ord") + F.length("key")) % 11 == 0
    rows = rows.withColumn("raw", F.when(~gap, F.col("raw")))
    return forecast.series(rows, "raw", ["key"])


_STEP = "abs(value - lag(value) OVER (PARTITION BY key ORDER BY m)) AS step"
_FRAME = "OVER (PARTITION BY key ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RECENT = "OVER (PARTITION BY key ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_FOLDS = f""", st AS (SELECT *, {_STEP} FROM ser),
fr AS (SELECT *, nullif(avg(step) {_FRAME}, 0) AS scale, last_value(value IGNORE NULLS) {_FRAME} AS naive,
  avg(value) {_FRAME} AS hist, CASE WHEN count(value) {_RECENT} = 3 THEN avg(value) {_RECENT} END AS ma FROM st),
folds AS (SELECT key, m, value, scale, model, fc, CASE WHEN value IS NULL THEN 'TARGET_UNAVAILABLE' WHEN fc IS NULL THEN 'MODEL_NOT_APPLICABLE' ELSE 'OK' END AS status
  FROM (SELECT *, 'naive' AS model, naive AS fc FROM fr UNION ALL SELECT *, 'historical_mean', hist FROM fr
        UNION ALL SELECT *, 'moving_average', ma FROM fr) WHERE slot >= 2)"""


@query(
    "series",
    _SERIES + f"SELECT key, {S.period('m')} AS period, {S.r('value', 4)} AS value FROM ser",
)
def _series(spark, sf):
    return order_series(spark, sf).select("key", "period", rd("value", 4))


@query(
    "backtest_folds",
    _SERIES
    + _FOLDS
    + f" SELECT key, {S.period('m')} AS period, model, {S.r('CASE WHEN value IS NOT NULL THEN fc END', 8)} AS forecast, status FROM folds",
)
def _folds(spark, sf):
    rows = forecast.backtest(order_series(spark, sf), ["key"])
    return rows.select("key", "period", "model", rd("forecast", 8), "status")


@query(
    "backtest_metrics",
    _SERIES
    + _FOLDS
    + f""" SELECT key, model, count(*) FILTER (WHERE status = 'OK') AS number_of_forecasts, {S.r("avg(abs(value - fc)) FILTER (WHERE status = 'OK')", 5)} AS mae,
    {S.r("sqrt(avg((value - fc) * (value - fc)) FILTER (WHERE status = 'OK'))", 5)} AS rmse, {S.r("avg(abs(value - fc) / scale) FILTER (WHERE status = 'OK')", 5)} AS mase,
    count(*) FILTER (WHERE status = 'TARGET_UNAVAILABLE') AS skipped_target, count(*) FILTER (WHERE status = 'MODEL_NOT_APPLICABLE') AS skipped_model
    FROM folds GROUP BY 1, 2""",
)
def _metrics(spark, sf):
    rows = forecast.evaluate(order_series(spark, sf), ["key"])
    return rows.select(
        "key", "model", "number_of_forecasts", rd("mae", 5), rd("rmse", 5), rd("mase", 5), "skipped_target", "skipped_model"
    )


_NEXT = f"""{_FOLDS}, res AS (SELECT key, model, count(*) AS k, stddev_samp(value - fc) AS sd FROM folds WHERE status = 'OK' GROUP BY 1, 2),
ends AS (SELECT key, max(m) FILTER (WHERE value IS NOT NULL) AS last_real, max(m) AS last_m, arg_max(value, m) FILTER (WHERE value IS NOT NULL) AS naive,
  avg(value) AS hist, count(value) AS used FROM ser GROUP BY 1),
tail AS (SELECT s.key, CASE WHEN count(value) = 3 THEN avg(value) END AS ma FROM ser s JOIN ends e ON s.key = e.key AND s.m > e.last_m - 3 GROUP BY 1),
nxt AS (SELECT e.key, model, last_real, used, CASE model WHEN 'naive' THEN naive WHEN 'historical_mean' THEN hist ELSE ma END AS fc
  FROM ends e JOIN tail USING (key), (SELECT unnest(['naive', 'historical_mean', 'moving_average']) AS model))"""


@query(
    "forecast_next",
    _SERIES
    + _NEXT
    + f""" SELECT key, model, coalesce({S.period('last_real + 1')}, 'UNKNOWN') AS forecast_period, {S.r('fc', 5)} AS forecast_value,
    {S.r('CASE WHEN k >= 3 THEN fc - 1.96 * sd END', 5)} AS lower_bound, {S.r('CASE WHEN k >= 3 THEN fc + 1.96 * sd END', 5)} AS upper_bound,
    used AS data_points_used, CASE WHEN fc IS NULL THEN 'MODEL_NOT_APPLICABLE' ELSE 'OK' END AS status FROM nxt LEFT JOIN res USING (key, model)""",
)
def _next(spark, sf):
    rows = forecast.forecast_next(order_series(spark, sf), ["key"])
    values = ("forecast_value", "lower_bound", "upper_bound")
    return rows.select("key", "model", "forecast_period", *[rd(c, 5) for c in values], "data_points_used", "status")


def _seasonal(history, lag: int):
    """Value `lag` months back: an example of a caller's own model."""
    return None if len(history) < lag or history.isna().iloc[-lag] else float(history.iloc[-lag])


@query(
    "backtest_custom_model",
    _SERIES
    + f""", lagged AS (SELECT *, lag(value, 12) OVER (PARTITION BY key ORDER BY m) AS fc FROM ser)
    SELECT key, {S.period('m')} AS period, 'seasonal' AS model, {S.r('CASE WHEN value IS NOT NULL THEN fc END', 5)} AS forecast,
    CASE WHEN value IS NULL THEN 'TARGET_UNAVAILABLE' WHEN fc IS NULL THEN 'MODEL_NOT_APPLICABLE' ELSE 'OK' END AS status FROM lagged WHERE slot >= 2""",
)
def _custom(spark, sf):
    rows = forecast.backtest_custom(order_series(spark, sf), ["key"], _seasonal, "seasonal", lag=12)
    period = forecast.C.period_text(F.col("month_ord")).alias("period")
    return rows.select("key", period, "model", rd("forecast", 5), "status")


@query(
    "calendar_periods",
    f"""WITH src AS ({S.fares_dirty()}), d AS (SELECT TRY_CAST(flight_date AS DATE) AS d FROM src), ok AS (SELECT d FROM d
    WHERE d BETWEEN DATE '1990-01-01' AND DATE '2000-01-01' + 400)
    SELECT {S.period('m')} AS period, (SELECT count(*) FROM d WHERE d IS NULL) AS unparseable, (SELECT count(*) FROM d WHERE d IS NOT NULL) - (SELECT count(*) FROM ok)
    AS out_of_range FROM (SELECT unnest(generate_series(min(year(d) * 12 + month(d)), max(year(d) * 12 + month(d)))) AS m FROM ok)""",
)
def _calendar(spark, sf):
    bounds = forecast.calendar_bounds(V.fares_dirty(spark, sf), F.lit("2000-01-01").cast("date"))
    both = bounds.select(F.struct("unparseable", "out_of_range").alias("s")).scalar()
    rows = forecast.calendar_periods(bounds)
    return rows.select("period", both["unparseable"].alias("unparseable"), both["out_of_range"].alias("out_of_range"))


# --- Panels ------------------------------------------------------------------------------------

_VOL = """, vol AS (SELECT month_ord, coalesce(CASE WHEN sum(CASE WHEN cv IS NOT NULL THEN coalesce(wn, 0) END) <> 0 THEN
 sum(cv * coalesce(wn, 0)) / sum(CASE WHEN cv IS NOT NULL THEN coalesce(wn, 0) END) END, avg(cv)) AS v FROM inflation GROUP BY 1)"""


@query(
    "panel_national",
    S.index_ctes()
    + _VOL
    + f"""SELECT n.period, {S.r('n.idx')} AS national_index, {S.r('n.mom')} AS mom_change_pct, {S.r('n.yoy')} AS yoy_change_pct,
    routes_covered, obs AS observations_used, {S.r('v.v')} AS national_volatility FROM national n JOIN vol v USING (month_ord)"""
    + IN_RANGE,
)
def _panel_national(spark, sf):
    rows = panel.build_panel(price_index(spark, sf)).national
    values = ("national_index", "mom_change_pct", "yoy_change_pct", "national_volatility")
    return rows.select("period", *[rd(c) for c in values], "routes_covered", "observations_used")


@query(
    "panel_routes",
    S.index_ctes(S.fares("nation"))
    + f"""SELECT period, route, status, {S.r('idx')} AS route_index, {S.r('mom')} AS mom_inflation_pct, {S.r('points')} AS contribution,
    {S.r('cv')} AS volatility, n AS observations_used FROM inflation WHERE month_ord BETWEEN {S.CURRENT_ORD - 5} AND {S.CURRENT_ORD}""",
)
def _panel_routes(spark, sf):
    periods = [forecast.C.shift_period(S.CURRENT, -k) for k in range(6)]
    rows = panel.build_panel(price_index(spark, sf, "nation"), periods).routes
    values = ("route_index", "mom_inflation_pct", "contribution", "volatility")
    return rows.select("period", "route", "status", *[rd(c) for c in values], "observations_used")


@query(
    "timeseries",
    S.index_ctes()
    + f"""SELECT {S.period('s.m')} AS period, {S.r('idx', 2)} AS index, {S.r('mom', 2)} AS mom, {S.r('yoy', 2)} AS yoy
    FROM (SELECT unnest(generate_series({S.CURRENT_ORD - 12}, {S.CURRENT_ORD + 60})) AS m) s
    LEFT JOIN (SELECT * FROM national {IN_RANGE}) n ON n.month_ord = s.m""",
)
def _timeseries(spark, sf):
    national = price_index(spark, sf).national()
    return panel.timeseries(national, forecast.C.shift_period(S.CURRENT, -12), forecast.C.shift_period(S.CURRENT, 60))


def _route_series(spark, sf):
    index = price_index(spark, sf)
    return forecast.series(index.routes(), "route_index", ["route"])


_ROUTE_SERIES = f""", ser AS (SELECT route AS key, month_ord AS m, idx AS value, row_number() OVER (PARTITION BY route ORDER BY month_ord) AS slot
 FROM routes {IN_RANGE})"""


@query(
    "route_backtests",
    S.index_ctes()
    + _ROUTE_SERIES
    + _FOLDS
    + f""" SELECT key AS route, model, count(*) FILTER (WHERE status = 'OK') AS number_of_forecasts,
    {S.r("avg(abs(value - fc)) FILTER (WHERE status = 'OK')", 5)} AS mae, {S.r("avg(abs(value - fc) / scale) FILTER (WHERE status = 'OK')", 5)} AS mase
    FROM folds GROUP BY 1, 2""",
)
def _route_backtests(spark, sf):
    rows = forecast.evaluate(_route_series(spark, sf), ["route"])
    return rows.select("route", "model", "number_of_forecasts", rd("mae", 5), rd("mase", 5))


@query(
    "route_forecasts",
    S.index_ctes()
    + _ROUTE_SERIES
    + _NEXT
    + f" SELECT key AS route, model, coalesce({S.period('last_real + 1')}, 'UNKNOWN') AS forecast_period, {S.r('fc', 5)} AS forecast_value, {S.r('CASE WHEN k >= 3 THEN fc - 1.96 * sd END', 5)} AS lower_bound FROM nxt LEFT JOIN res USING (key, model)",
)
def _route_forecasts(spark, sf):
    rows = forecast.forecast_next(_route_series(spark, sf), ["route"])
    return rows.select("route", "model", "forecast_period", rd("forecast_value", 5), rd("lower_bound", 5))


@query(
    "route_forecast",
    S.index_ctes()
    + _ROUTE_SERIES
    + _NEXT
    + f" SELECT key AS route, model, coalesce({S.period('last_real + 1')}, 'UNKNOWN') AS forecast_period, {S.r('fc', 5)} AS forecast_value FROM nxt WHERE key = 'DEL-BOM'",
)
def _route_forecast(spark, sf):
    """One route by name; a name without a series would fail the query."""
    rows = forecast.forecast_key(_route_series(spark, sf), "route", "DEL-BOM")
    return rows.select("route", "model", "forecast_period", rd("forecast_value", 5))


@query(
    "national_forecast",
    S.index_ctes()
    + f""", ser AS (SELECT 'all' AS key, month_ord AS m, CASE WHEN coverage >= 0.9 THEN idx END AS value,
    row_number() OVER (ORDER BY month_ord) AS slot FROM national {IN_RANGE})"""
    + _NEXT
    + f" SELECT model, coalesce({S.period('last_real + 1')}, 'UNKNOWN') AS forecast_period, {S.r('fc', 5)} AS forecast_value, {S.r('CASE WHEN k >= 3 THEN fc + 1.96 * sd END', 5)} AS upper_bound, used AS data_points_used FROM nxt LEFT JOIN res USING (key, model)",
)
def _national_forecast(spark, sf):
    points = forecast.series(
        price_index(spark, sf).national(), "national_index", coverage="coverage_rate", min_coverage=0.9
    )
    rows = forecast.forecast_next(points)
    return rows.select("model", "forecast_period", rd("forecast_value", 5), rd("upper_bound", 5), "data_points_used")


# --- Booking windows ---------------------------------------------------------------------------


@query(
    "booking_windows",
    f"""WITH src AS ({S.fares_dirty()}), d AS (SELECT *, CASE WHEN regexp_full_match(flight_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND
    regexp_full_match(booking_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN datediff('day', TRY_CAST(booking_date AS DATE), TRY_CAST(flight_date AS DATE)) END AS days FROM src)
    SELECT CASE WHEN coalesce(flight_date, '') = '' OR coalesce(booking_date, '') = '' THEN 'missing_date' WHEN days IS NULL THEN 'invalid_date'
    WHEN days < 0 THEN 'negative_horizon' ELSE {S.band('days', S.BOOKING_WINDOWS, "'out_of_range'")} END AS outcome, count(*) AS n FROM d GROUP BY 1""",
)
def _windows(spark, sf):
    return collection.partition_accounting(V.fares_dirty(spark, sf))


@query(
    "booking_window_panels",
    S.index_ctes(by="booking_window")
    + f"SELECT booking_window, period, {S.r('idx')} AS national_index, {S.r('mom')} AS mom_change_pct, routes_covered FROM national WHERE month_ord BETWEEN {S.BASE_ORD} AND {S.CURRENT_ORD}",
)
def _window_panels(spark, sf):
    panels = panel.booking_window_panels(V.fares(spark, sf), IndexConfig(S.BASE), S.BASE, S.CURRENT)
    return panels.national.select(
        F.col("window").alias("booking_window"), "period", rd("national_index"), rd("mom_change_pct"), "routes_covered"
    )


@query(
    "booking_window_statuses",
    S.index_ctes(by="booking_window")
    + f""", rec AS (SELECT {S.band('datediff(' + "'day'" + ', bd, fd)', S.BOOKING_WINDOWS, 'NULL')} AS window_name, count(*) AS n FROM checked GROUP BY 1)
    SELECT window_name AS booking_window, n AS record_count, 'OK' AS status FROM rec WHERE window_name IS NOT NULL""",
)
def _window_statuses(spark, sf):
    fares = V.fares(spark, sf)
    panels = panel.booking_window_panels(fares, IndexConfig(S.BASE), S.BASE, S.CURRENT)
    rows = panel.window_statuses(fares, panels)
    return rows.select(F.col("window").alias("booking_window"), "record_count", "status")


@query(
    "panel_views",
    S.index_ctes()
    + f"""SELECT route, count(*) AS months, count(*) FILTER (WHERE status = 'OK') AS ok_months, (SELECT count(*) FROM national WHERE idx IS NOT NULL
    AND month_ord BETWEEN {S.BASE_ORD} AND {S.CURRENT_ORD}) AS national_months FROM routes WHERE month_ord BETWEEN {S.BASE_ORD} AND {S.CURRENT_ORD} GROUP BY route""",
)
def _panel_views(spark, sf):
    periods = [forecast.C.ord_period(m) for m in range(S.BASE_ORD, S.CURRENT_ORD + 1)]
    built = panel.build_panel(price_index(spark, sf), periods)
    national = built.national_series(ok_only=True).agg(F.count(F.lit(1)).alias("n")).scalar()
    ok = built.routes_ok().groupBy("route").agg(F.count(F.lit(1)).alias("ok_months"))
    months = built.routes.groupBy("route").agg(F.count(F.lit(1)).alias("months"))
    rows = built.route_list().join(months, "route").join(ok, "route", "left")
    return rows.select("route", "months", F.coalesce("ok_months", F.lit(0)).alias("ok_months"), national.alias("national_months"))


@query(
    "ingest_counts",
    f"""WITH src AS ({S.fares_dirty()}), u AS (SELECT coalesce(observation_id, '') <> '' AND coalesce(airline, '') <> '' AND coalesce(origin, '') <> ''
    AND coalesce(destination, '') <> '' AND coalesce(flight_date, '') <> '' AND coalesce(booking_date, '') <> '' AND coalesce(currency, '') <> '' AND total_fare > 0 AS ok FROM src)
    SELECT count(*) AS loaded, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE NOT ok) AS dropped FROM u""",
)
def _ingest(spark, sf):
    return collection.ingest_counts(V.fares_dirty(spark, sf)).select("loaded", "usable", "dropped")


@query(
    "ingest_guard",
    f"""WITH src AS ({S.fares_dirty()}), u AS (SELECT source, coalesce(observation_id, '') <> '' AND coalesce(airline, '') <> '' AND coalesce(origin, '') <> ''
    AND coalesce(destination, '') <> '' AND coalesce(flight_date, '') <> '' AND coalesce(booking_date, '') <> '' AND coalesce(currency, '') <> '' AND total_fare > 0 AS ok FROM src)
    SELECT CASE WHEN source = 'N' THEN 'mock' ELSE 'real' END AS kind, 'mixed' AS batch, count(*) AS n FROM u WHERE ok GROUP BY 1
    UNION ALL SELECT 'real', 'real', count(*) FROM u WHERE ok AND source <> 'N'""",
)
def _guard(spark, sf):
    """A batch of both kinds passes by leave only, a batch of real rows alone without."""
    rows = V.fares_dirty(spark, sf).withColumn("is_mock", F.col("source") == "N")
    kind = F.when(F.col("is_mock"), "mock").otherwise("real").alias("kind")
    mixed = collection.guarded_ingest(rows, allow_mock=True).select(kind, F.lit("mixed").alias("batch"))
    real = collection.guarded_ingest(rows.filter("not is_mock")).select(kind, F.lit("real").alias("batch"))
    return mixed.unionByName(real).groupBy("kind", "batch").agg(F.count(F.lit(1)).alias("n"))


# --- Official series ---------------------------------------------------------------------------

_CPI = """cpi AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, floor(avg(o_totalprice)) / 1000 AS ix,
 (year(o_orderdate) * 12 + month(o_orderdate)) % 7 = 0 AS imputed FROM orders GROUP BY 1)"""


def cpi_rows(spark, sf):
    day = F.col("o_orderdate").cast("date")
    m = F.year(day) * 12 + F.month(day)
    monthly = V.table(spark, sf, "orders").groupBy(F.year(day).alias("year"), F.month(day).alias("mo"), m.alias("m"))
    rows = monthly.agg((F.floor(F.avg("o_totalprice")) / 1000).alias("index"))
    return rows.select(
        "year",
        V.pick(MONTH_NAMES, F.col("mo") - 1).alias("month"),
        "index",
        F.lit(None).cast("double").alias("inflation"),
        F.when(F.col("m") % 7 == 0, "Y").otherwise(" n ").alias("imputation"),
        F.lit(2012).alias("base_year"),
    )


def cpi(spark, sf):
    return official_series(cpi_rows(spark, sf))


@query(
    "official_series",
    f"WITH {_CPI} SELECT {S.period('m')} AS period, {S.r('ix', 4)} AS index, imputed FROM cpi",
)
def _official(spark, sf):
    return cpi(spark, sf).select("period", rd("index", 4), "imputed")


@query(
    "official_series_file",
    f"WITH {_CPI} SELECT {S.period('m')} AS period, {S.r('ix', 4)} AS index, imputed, 2012 AS base_year FROM cpi",
)
def _official_file(spark, sf):
    """The same series landed as a CSV file and read back by the reader."""
    path = f"{shared_dir(spark).rstrip('/')}/official-{uuid.uuid4().hex}"
    cpi_rows(spark, sf).write.option("header", True).csv(path)
    return load_official_series(spark, path).select("period", rd("index", 4), "imputed", F.col("base_year").cast("int").alias("base_year"))


_COMPARE = f""", {_CPI}, ov AS (SELECT month_ord AS m, idx AS a0, ix AS b0, NOT imputed AS inc FROM national n JOIN cpi ON cpi.m = n.month_ord WHERE idx IS NOT NULL AND n.month_ord >= (SELECT lo FROM first_month)),
reb AS (SELECT m, inc, 100 * a0 / first_value(a0) OVER (ORDER BY m) AS a, 100 * b0 / first_value(b0) OVER (ORDER BY m) AS b FROM ov),
cmp AS (SELECT c.*, CASE WHEN c.inc AND p.inc THEN (c.a / p.a - 1) * 100 END AS am, CASE WHEN c.inc AND p.inc THEN (c.b / p.b - 1) * 100 END AS bm,
 CASE WHEN c.inc AND y.inc THEN (c.a / y.a - 1) * 100 END AS ay, CASE WHEN c.inc AND y.inc THEN (c.b / y.b - 1) * 100 END AS by_ FROM reb c
 LEFT JOIN reb p ON p.m = c.m - 1 LEFT JOIN reb y ON y.m = c.m - 12)"""


def _comparison(spark, sf):
    ours = price_index(spark, sf).national().select("month_ord", F.col("national_index").alias("value"))
    return benchmark.compare(ours, cpi(spark, sf))


@query(
    "cpi_comparison",
    S.index_ctes()
    + _COMPARE
    + f"SELECT {S.period('m')} AS period, {S.r('a', 5)} AS our_rebased, {S.r('b', 5)} AS official_rebased, inc AS included, {S.r('am', 5)} AS our_mom_pct, {S.r('bm', 5)} AS official_mom_pct, {S.r('am - bm', 5)} AS mom_difference, {S.r('ay - by_', 5)} AS yoy_difference FROM cmp",
)
def _compare(spark, sf):
    values = ("our_rebased", "official_rebased", "our_mom_pct", "official_mom_pct", "mom_difference", "yoy_difference")
    return _comparison(spark, sf).select("period", "included", *[rd(c, 5) for c in values])


@query(
    "cpi_summary",
    S.index_ctes()
    + _COMPARE
    + f"SELECT count(*) AS overlap_period_count, {S.period('min(m)')} AS overlap_start, {S.r('avg(abs(am - bm))', 5)} AS mean_absolute_mom_difference, {S.r('corr(am, bm)', 5)} AS mom_correlation, {S.r('avg(abs(ay - by_))', 5)} AS mean_absolute_yoy_difference, count(ay) AS yoy_period_count, 'OK' AS status FROM cmp",
)
def _summary(spark, sf):
    values = ("mean_absolute_mom_difference", "mom_correlation", "mean_absolute_yoy_difference")
    row = benchmark.summary(_comparison(spark, sf))
    return row.select("overlap_period_count", "overlap_start", *[rd(c, 5) for c in values], "yoy_period_count", "status")
