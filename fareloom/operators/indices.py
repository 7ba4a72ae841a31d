"""Route indices against the base month, national index, changes and contributions.

Weights are fixed at the base month and cleaning works per route and month, so nothing depends
on which month is looked at: one plan yields every month. Route-level tables have one row per
route and month; their sizes are bounded by the route list and the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import columns as C
from .weights import metro_weight, normalize, one_per_route, weights_for_period

OK = "OK"


def calendar_lag(value: str | Column, months: int, keys: tuple[str, ...] = (), order: str = "month_ord") -> Column:
    """The value exactly `months` calendar months earlier, null if that month has no row."""
    window = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    return F.first(value).over(window.orderBy(order).rangeBetween(-months, -months))


def route_status(base: Column, now: Column) -> Column:
    """Status from the base-month and current-month fact (structs, null = no row). Order matters."""
    thin_base = ~base["sufficient"] | base["representative_fare"].isNull() | (base["representative_fare"] == 0)
    return (
        F.when(base.isNull() & now.isNull(), "NO_BASE_DATA")
        .when(base.isNull(), "NEW_ROUTE")
        .when(thin_base, "INSUFFICIENT_DATA")
        .when(now.isNull(), "DISCONTINUED")
        .when(~now["sufficient"], "INSUFFICIENT_DATA")
        .otherwise(OK)
    )


def _index_at(base: Column, now: Column) -> Column:
    value = 100.0 * F.try_divide(now["representative_fare"], base["representative_fare"])
    return F.when(route_status(base, now) == OK, value)


def route_universe(
    facts: DataFrame, weights: DataFrame | None, config: IndexConfig, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per route that is observed in any month or weighted at the base month.

    `by` names columns that keep several indices apart in one plan, such as a booking window or
    a method label; weights may carry them too.

    The months of a route travel with it as a map (at most one entry per calendar month), so
    base month, current month and lagged months are lookups in the row instead of self-joins.
    """
    entry = F.struct(
        "month_ord",
        F.struct("representative_fare", "observations_used", "sufficient", "mean", "sd").alias("fact"),
    )
    per_route = facts.groupBy(*by, "route").agg(F.map_from_entries(F.collect_list(entry)).alias("months"))
    if weights is None:
        parts = F.split("route", "-", 2)
        return normalize(per_route.withColumn("weight", metro_weight(parts[0], parts[1])), by)
    shared = tuple(c for c in by if c in weights.columns)
    if shared != by:
        raise ValueError(f"weights must carry the columns {by}")
    basket = one_per_route(normalize(weights_for_period(weights, config.base_period, by), by), by)
    return per_route.join(basket, [*by, "route"], "full_outer")


def route_indices(
    facts: DataFrame,
    config: IndexConfig,
    first: str | Column,
    last: str | Column,
    weights: DataFrame | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Every route of the universe in every month first..last, with its two calendar lags.

    `first` and `last` are periods, or month-ordinal columns such as scalar subqueries.
    """
    lo = F.lit(C.period_ord(first)) if isinstance(first, str) else first
    hi = F.lit(C.period_ord(last)) if isinstance(last, str) else last
    spine = route_universe(facts, weights, config, by).withColumn("month_ord", F.explode(F.sequence(lo, hi)))

    def month(offset: int) -> Column:
        return F.try_element_at("months", F.col("month_ord") - offset)

    base = F.try_element_at("months", F.lit(C.period_ord(config.base_period)))
    parts = F.split("route", "-", 2)
    now = spine.withColumns({"base": base, "now": month(0), "m1": month(1), "m12": month(12)})
    b = F.col("base")
    index, i1, i12 = (_index_at(b, F.col(c)) for c in ("now", "m1", "m12"))
    return now.select(
        *by,
        "route",
        parts[0].alias("origin"),
        parts[1].alias("destination"),
        "month_ord",
        C.period_text(F.col("month_ord")).alias("period"),
        b["representative_fare"].alias("base_period_fare"),
        F.col("now")["representative_fare"].alias("period_fare"),
        index.alias("route_index"),
        F.coalesce(F.col("now")["observations_used"], F.lit(0)).alias("observations_used"),
        F.col("weight").alias("weight_raw"),
        "weight_normalized",
        route_status(b, F.col("now")).alias("status"),
        i1.alias("route_index_prev_month"),
        i12.alias("route_index_prev_year"),
        F.col("now")["mean"].alias("fare_mean"),
        F.col("now")["sd"].alias("fare_sd"),
    )


def usable() -> Column:
    """Rows that enter the national index: an index and a weight that is not zero."""
    return F.col("route_index").isNotNull() & (F.coalesce("weight_normalized", F.lit(0.0)) != 0)


def national_value(method: str) -> Column:
    """Weighted mean of the usable route indices, arithmetic or of logs."""
    w = F.when(usable(), F.col("weight_normalized"))
    if method == "arithmetic":
        return F.try_divide(F.sum(w * F.col("route_index")), F.sum(w))
    return F.exp(F.try_divide(F.sum(w * F.ln(F.col("route_index") / 100.0)), F.sum(w))) * 100.0


def coverage_rate() -> Column:
    w = F.coalesce("weight_normalized", F.lit(0.0))
    share = F.try_divide(F.sum(F.when(F.col("status") == OK, w).otherwise(0.0)), F.sum(w))
    return F.coalesce(share, F.lit(0.0))


def _sorted_routes(test: Column) -> Column:
    """Sorted route list of a month, from at most one row per route."""
    return F.sort_array(F.collect_list(F.when(test, F.col("route"))))


def national_index(routes: DataFrame, config: IndexConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per month (and `by` group): index, changes, coverage and route counts.

    Changes look back by calendar month within the rows given, so pass `routes` from twelve
    months before the first month of interest on.
    """
    ok = F.col("status") == OK
    now = ok
    prev_month_ok = F.col("route_index_prev_month").isNotNull()
    prev_year_ok = F.col("route_index_prev_year").isNotNull()
    monthly = routes.groupBy(*by, "month_ord", "period").agg(
        national_value(config.aggregation_method).alias("national_index"),
        F.count_if(ok).alias("routes_covered"),
        F.count(F.lit(1)).alias("routes_total"),
        F.count_if(F.col("status") != "NO_BASE_DATA").alias("routes_with_data"),
        coverage_rate().alias("coverage_rate"),
        F.sum("observations_used").alias("observations_used"),
        *[
            _sorted_routes(F.col("status") == status).alias(f"routes_{status.lower()}")
            for status in ("NO_BASE_DATA", "INSUFFICIENT_DATA", "NEW_ROUTE", "DISCONTINUED")
        ],
        _sorted_routes(now != prev_month_ok).alias("routes_changed_mom"),
        _sorted_routes(now != prev_year_ok).alias("routes_changed_yoy"),
    )
    return with_changes(monthly, "national_index", by)


def with_changes(monthly: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Month-over-month and year-over-year change of a series with one row per month."""
    return monthly.withColumns(
        {
            "mom_change_pct": C.pct_change(F.col(value), calendar_lag(value, 1, by)),
            "yoy_change_pct": C.pct_change(F.col(value), calendar_lag(value, 12, by)),
        }
    )


def quality_flags(removed: Column, received: Column) -> Column:
    """Text flags of a month, in fixed order."""

    def listing(column: str, text: str) -> Column:
        routes = F.col(column)
        message = F.concat(F.size(routes).cast("string"), F.lit(f" route(s) {text}: "), F.concat_ws(", ", routes))
        return F.when(F.size(routes) > 0, message)

    share = 100.0 * F.try_divide(removed, received)
    return F.array_compact(
        F.array(
            listing("routes_no_base_data", "without base-month data"),
            listing("routes_insufficient_data", "with too few observations"),
            listing("routes_new_route", "new since the base month"),
            listing("routes_discontinued", "discontinued"),
            F.when(share > 20, F.concat(F.format_string("%.1f", share), F.lit("% of the input was removed"))),
            listing("routes_changed_mom", "usable in only one of this and the previous month"),
            listing("routes_changed_yoy", "usable in only one of this month and a year before"),
        )
    )


def contributions(routes: DataFrame, config: IndexConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Points each route adds to the month's change.

    Weights are renormalised by the usable weight of the same month, the denominator of the
    national index, so with an unchanged set of routes the points sum to the index change.
    """
    w = F.when(usable(), F.col("weight_normalized"))
    total = F.sum(w).over(W.partitionBy(*by, "month_ord"))
    weight = F.coalesce(F.try_divide(F.coalesce("weight_normalized", F.lit(0.0)), total), F.lit(0.0))
    now, before = F.col("route_index"), F.col("route_index_prev_month")
    if config.aggregation_method == "arithmetic":
        points = F.col("contribution_weight") * (now - before)
    else:
        points = F.col("contribution_weight") * (F.ln(now) - F.ln(before)) * 100.0
    return routes.withColumn("contribution_weight", weight).withColumn("contribution_points", points)


def ranked_contributions(routes: DataFrame, config: IndexConfig) -> DataFrame:
    """Contributions with their rank in the month: largest absolute value first, nulls last."""
    size = F.abs("contribution_points").desc_nulls_last()
    ranking = W.partitionBy("month_ord").orderBy(size, "route")
    return contributions(routes, config).withColumn("rank", F.row_number().over(ranking))


def inflation_table(
    routes: DataFrame, config: IndexConfig, traffic_weights: DataFrame | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per route and month: index, changes, weights, contribution, volatility, status.

    A change needs the route to be OK in both months. `traffic_weights` has route, traffic_weight.
    """
    out = contributions(routes, config, by)
    if traffic_weights is None:
        out = out.withColumn("traffic_weight", F.lit(None).cast("double"))
    else:
        out = out.join(traffic_weights.select("route", "traffic_weight"), "route", "left")
    enough = F.col("observations_used") >= config.min_observations
    return out.select(
        *by,
        "route",
        "origin",
        "destination",
        "month_ord",
        "period",
        F.col("route_index").alias("current_index"),
        C.pct_change(F.col("route_index"), F.col("route_index_prev_month")).alias("mom_inflation_pct"),
        C.pct_change(F.col("route_index"), F.col("route_index_prev_year")).alias("yoy_inflation_pct"),
        F.col("weight_normalized").alias("weight"),
        "traffic_weight",
        F.col("contribution_points").alias("contribution"),
        F.when(enough, F.try_divide("fare_sd", "fare_mean")).alias("volatility"),
        "status",
        "observations_used",
        "route_index_prev_month",
        "contribution_weight",
        "base_period_fare",
        "period_fare",
    )


def route_listing(inflation: DataFrame, provenance: str) -> DataFrame:
    """Short listing of one or more months: rounded change, status word, provenance."""
    status = F.when(F.col("status") == OK, "active").when(F.col("status") == "NEW_ROUTE", "new").otherwise("inactive")
    return inflation.select(
        "period",
        "route",
        F.col("current_index").alias("route_index"),
        F.round("mom_inflation_pct", 2).alias("mom"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        "contribution",
        F.coalesce("weight", F.lit(0.0)).alias("traffic_coverage"),
        status.alias("status"),
        F.lit(provenance).alias("data_source"),
    )


def inflation_matrix(inflation: DataFrame, airports: list[str], metric: str = "mom") -> DataFrame:
    """Origin x destination. `airports` names the columns; a pair without a value stays null."""
    if metric not in ("mom", "yoy"):
        raise ValueError(f"metric must be mom or yoy, got {metric!r}")
    return inflation.groupBy("origin").pivot("destination", sorted(airports)).agg(F.first(f"{metric}_inflation_pct"))
