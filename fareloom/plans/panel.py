"""Forecasting panels: national and route tables for all months, also per booking window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig, VolatilityConfig
from ..constants import BOOKING_WINDOWS
from ..functions import columns as C
from ..operators import cleaning, facts, indices, volatility
from ..operators.collection import guarded_ingest, structurally_usable
from ..operators.forecast import check_periods
from ..operators.validation import enrich, with_rejection_reason
from ..session import stage
from .price_index import PriceIndex

NATIONAL_COLUMNS = (
    "period", "month_ord", "national_index", "mom_change_pct", "yoy_change_pct", "routes_covered", "routes_total",
    "coverage_rate", "observations_used", "national_volatility", "national_classification",
)

ROUTE_COLUMNS = (
    "period", "month_ord", "route", "origin", "destination", "status", "route_index", "mom_inflation_pct",
    "yoy_inflation_pct", "weight_normalized", "traffic_weight", "contribution", "volatility", "observations_used",
)


@dataclass(frozen=True)
class Panel:
    """Two tables with one row per month and per route and month."""

    national: DataFrame
    routes: DataFrame

    def national_series(self, ok_only: bool = False) -> DataFrame:
        rows = self.national
        return rows.filter(F.col("national_index").isNotNull()) if ok_only else rows

    def routes_ok(self) -> DataFrame:
        return self.routes.filter(F.col("status") == indices.OK)

    def route_series(self, route: str, ok_only: bool = False) -> DataFrame:
        rows = (self.routes_ok() if ok_only else self.routes).filter(F.col("route") == route)
        return rows.orderBy("month_ord")

    def route_list(self) -> DataFrame:
        return self.routes.select("route").distinct().orderBy("route")


def build_panel(index: PriceIndex, periods: Sequence[str] | None = None) -> Panel:
    """All months at once. Explicit periods are checked, sorted and define the range that is built.

    The facts are staged: both tables read them, and they have one row per route and month.
    """
    wanted = check_periods(list(periods)) if periods is not None else None
    if wanted is not None and not wanted:
        raise ValueError("no periods to build")
    first, last = (wanted[0], wanted[-1]) if wanted else (None, None)
    config = index.config
    table = stage(index.facts, "route-month-facts")
    if wanted:
        lo, hi = F.lit(C.period_ord(first)), F.lit(C.period_ord(last))
    else:
        span = table.agg(F.min("month_ord").alias("lo"), F.max("month_ord").alias("hi"))
        lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    routes = indices.route_indices(table, config, lo, hi, index.weights)
    led = indices.route_indices(table, config, lo - 12, hi, index.weights)
    national = _national(led, config, index.volatility_config).filter(F.col("month_ord") >= lo)
    detail = _routes(indices.inflation_table(routes, config))
    if wanted:
        national, detail = (d.filter(F.col("period").isin(wanted)) for d in (national, detail))
    return Panel(national.select(*NATIONAL_COLUMNS), detail.select(*ROUTE_COLUMNS))


def _routes(inflation: DataFrame) -> DataFrame:
    return inflation.withColumnsRenamed({"current_index": "route_index", "weight": "weight_normalized"})


def _national(
    routes: DataFrame, config: IndexConfig, vol: VolatilityConfig, by: tuple[str, ...] = ()
) -> DataFrame:
    """National rows with the weighted volatility of the month, from the same route rows."""
    enough = F.col("observations_used") >= vol.min_observations
    cv = F.when(enough, F.try_divide("fare_sd", "fare_mean"))
    w = F.when(cv.isNotNull(), F.coalesce("weight_normalized", F.lit(0.0)))
    weighted = F.when(F.sum(w) != 0, F.try_divide(F.sum(cv * w), F.sum(w)))
    spread = routes.groupBy(*by, "month_ord").agg(F.coalesce(weighted, F.avg(cv)).alias("national_volatility"))
    out = indices.national_index(routes, config, by).join(spread, [*by, "month_ord"])
    return out.withColumn("national_classification", volatility.classify(F.col("national_volatility"), vol))


# --- Booking windows ---------------------------------------------------------------------------


def booking_window_panels(
    quotes: DataFrame,
    config: IndexConfig,
    first: str,
    last: str,
    vol: VolatilityConfig = VolatilityConfig(),
    order_cols: tuple[str, ...] = cleaning.ORDER_COLS,
    allow_mock: bool = False,
) -> Panel:
    """One panel per booking window in one plan: the window is one more key everywhere.

    A thin window never affects another one. Quotes that say whether they are mocks pass the guard of an ingest: no usable
    one, or real and mock ones together without leave, fails the query.
    """
    by = ("window",)
    if "is_mock" in quotes.columns:
        quotes = guarded_ingest(quotes, allow_mock)
    table = stage(_window_facts(quotes, config, order_cols), "window-facts")
    lo, hi = F.lit(C.period_ord(first)), F.lit(C.period_ord(last))
    routes = indices.route_indices(table, config, lo, hi, None, by)
    led = indices.route_indices(table, config, lo - 12, hi, None, by)
    national = _national(led, config, vol, by).filter(F.col("month_ord") >= lo)
    detail = _routes(indices.inflation_table(routes, config, None, by))
    return Panel(national.select(*by, *NATIONAL_COLUMNS), detail.select(*by, *ROUTE_COLUMNS))


def _windowed(quotes: DataFrame) -> DataFrame:
    """Usable quotes that fall into a booking window, with its name."""
    usable = quotes.filter(structurally_usable(quotes))
    days = C.advance_days(F.col("flight_date"), F.col("booking_date"))
    return usable.withColumn("window", C.booking_window(days)).filter(F.col("window").isNotNull())


def _window_facts(quotes: DataFrame, config: IndexConfig, order_cols: tuple[str, ...]) -> DataFrame:
    checked = with_rejection_reason(_windowed(quotes), config.fare_field)
    rows = enrich(checked.filter(F.col("rejection_reason").isNull()), config)
    needed = ["window", "observation_id", "route", "month_ord", "standardized_fare"]
    order = [c for c in order_cols if c in rows.columns and c not in needed]
    unique = cleaning.first_per_key(rows.select(*needed, *order), ["window", "observation_id"], order_cols)
    keys = ["window", "route", "month_ord"]
    counts = stage(cleaning.fare_counts(unique, keys), "window-counts")
    return facts.representative_fares(cleaning.survivors(counts, keys, config), keys, config)


def window_statuses(quotes: DataFrame, panel: Panel) -> DataFrame:
    """Per booking window: usable records and OK, INSUFFICIENT_DATA (no index row) or NO_DATA."""
    names = quotes.sparkSession.createDataFrame([(w,) for w, *_ in BOOKING_WINDOWS], "window string")
    records = _windowed(quotes).groupBy("window").agg(F.count(F.lit(1)).alias("record_count"))
    built = panel.national.groupBy("window").agg(F.count(F.lit(1)).alias("months"))
    out = names.join(records, "window", "left").join(built, "window", "left")
    status = (
        F.when(F.col("record_count").isNull(), "NO_DATA").when(F.col("months").isNull(), "INSUFFICIENT_DATA").otherwise("OK")
    )
    return out.select("window", F.coalesce("record_count", F.lit(0)).alias("record_count"), status.alias("status"))


# --- Views -------------------------------------------------------------------------------------


def timeseries(national: DataFrame, start: str, end: str) -> DataFrame:
    """One row per asked month with index and changes rounded to 2; null where nothing was computed."""
    lo, hi = C.period_ord(start), C.period_ord(end)
    spine = national.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("month_ord"))
    values = national.select(
        "month_ord",
        F.round("national_index", 2).alias("index"),
        F.round("mom_change_pct", 2).alias("mom"),
        F.round("yoy_change_pct", 2).alias("yoy"),
    )
    out = spine.join(values, "month_ord", "left")
    return out.select(C.period_text(F.col("month_ord")).alias("period"), "index", "mom", "yoy")
