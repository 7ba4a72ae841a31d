"""The same quotes under several methods or route sets, in one plan each."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import columns as C
from ..operators import cleaning, indices
from ..operators.quantiles import exact_percentiles, trimmed_means
from ..operators.weights import metro_weight
from ..session import stage
from .price_index import PriceIndex


@dataclass(frozen=True)
class Method:
    label: str
    representative: str = "median"
    outliers: str = "iqr"
    aggregation: str = "arithmetic"
    horizon: str | None = None
    weights: str = "metro"


METHODS = (
    Method("median+iqr"),
    Method("mean+iqr", representative="mean"),
    Method("median+mad", outliers="mad"),
    Method("median+percentile", outliers="percentile"),
    Method("median+none", outliers="none"),
    Method("trimmed_mean+iqr", representative="trimmed_mean"),
    Method("median+iqr+geometric", aggregation="geometric"),
    Method("median+iqr+15-30", horizon="15-30"),
    Method("median+iqr+uniform", weights="uniform"),
    Method("median+iqr+traffic", weights="traffic"),
)


def sensitivity(
    quotes: DataFrame,
    base_period: str,
    current_period: str,
    traffic_weights: DataFrame,
    methods: tuple[Method, ...] = METHODS,
) -> DataFrame:
    """Index of one month per method, its difference to the first method, and the spread.

    The quotes are shuffled once: one grouping per id finds the first quote overall and the first
    per horizon that some method asks for. All methods then read the same staged value counts.
    """
    config = IndexConfig(base_period)
    pools = [None] + sorted({m.horizon for m in methods if m.horizon})
    every_month = stage(_pooled_counts(PriceIndex(quotes, config), pools), "method-counts")
    # Fares of two months decide the index, but routes of all months belong to the basket.
    months = [C.period_ord(base_period), C.period_ord(current_period)]
    counts = every_month.filter(F.col("month_ord").isin(*months))
    routes = every_month.select("pool", "route").distinct()

    keys = ["pool", "route", "month_ord"]
    parts = []
    for rule in sorted({m.outliers for m in methods}):
        used = [m.horizon or "all" for m in methods if m.outliers == rule]
        mine = counts.filter(F.col("pool").isin(*used))
        kept = cleaning.survivors(mine, keys, replace(config, outlier_method=rule))
        parts.append(kept.withColumn("rule", F.lit(rule)))
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)

    group = ["rule", *keys]
    fares = exact_percentiles(kept, group, {"median": 0.5}, "standardized_fare", moments=True)
    trimmed = trimmed_means(kept, group, config.trimmed_mean_proportion, "standardized_fare")
    fares = fares.join(trimmed, group, "left")
    facts = _per_method(fares, methods, config)
    weights = _method_weights(routes, methods, traffic_weights)
    by = ("label", "aggregation", "position")
    month = C.period_ord(current_period)
    rows = indices.route_indices(facts, config, current_period, current_period, weights, by)
    out = (
        rows.filter(F.col("month_ord") == month)
        .groupBy(*by)
        .agg(
            indices.national_value("arithmetic").alias("arithmetic"),
            indices.national_value("geometric").alias("geometric"),
            F.count_if(F.col("status") == indices.OK).alias("routes_covered"),
            indices.coverage_rate().alias("coverage_rate"),
        )
    )
    value = F.when(F.col("aggregation") == "geometric", F.col("geometric")).otherwise(F.col("arithmetic"))
    # Ten rows from here on.
    every = W.partitionBy(F.lit(1))
    first = F.first("national_index").over(every.orderBy("position"))
    return out.withColumn("national_index", value).select(
        "label",
        "national_index",
        "routes_covered",
        "coverage_rate",
        (F.col("national_index") - first).alias("delta"),
        (F.max("national_index").over(every) - F.min("national_index").over(every)).alias("spread"),
    )


def _pooled_counts(index: PriceIndex, pools: list[str | None]) -> DataFrame:
    rows = index.enriched
    needed = ["observation_id", "route", "month_ord", "booking_horizon_bucket", "standardized_fare"]
    order = [c for c in index.order_cols if c in rows.columns and c != "observation_id" and c not in needed]
    packed = F.struct(*order, *[c for c in needed if c != "observation_id"])
    firsts = [
        F.min(packed if p is None else F.when(F.col("booking_horizon_bucket") == p, packed)).alias(f"f{i}")
        for i, p in enumerate(pools)
    ]
    grouped = rows.select(*needed, *order).groupBy("observation_id").agg(*firsts)
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"f{i}").isNotNull(),
                    F.struct(
                        F.lit(p or "all").alias("pool"),
                        F.col(f"f{i}.route").alias("route"),
                        F.col(f"f{i}.month_ord").alias("month_ord"),
                        F.col(f"f{i}.standardized_fare").alias("standardized_fare"),
                    ),
                )
                for i, p in enumerate(pools)
            ]
        )
    )
    unique = grouped.select(F.explode(entries).alias("e")).select("e.*")
    return cleaning.fare_counts(unique, ["pool", "route", "month_ord"])


def _per_method(fares: DataFrame, methods: tuple[Method, ...], config: IndexConfig) -> DataFrame:
    """The facts of every method: its rule and pool select the row, its representative the column."""

    def chosen(m: Method) -> Column:
        if m.representative == "median":
            return F.col("median")
        if m.representative == "mean":
            return F.col("mean")
        return F.when(F.col("total") < 3, F.col("median")).otherwise(F.col("trimmed_mean"))

    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("rule") == m.outliers) & (F.col("pool") == (m.horizon or "all")),
                    F.struct(
                        F.lit(m.label).alias("label"),
                        F.lit(m.aggregation).alias("aggregation"),
                        F.lit(i).alias("position"),
                        chosen(m).alias("representative_fare"),
                    ),
                )
                for i, m in enumerate(methods)
            ]
        )
    )
    return fares.withColumn("e", F.explode(entries)).select(
        "e.*",
        "route",
        "month_ord",
        F.col("total").alias("observations_used"),
        (F.col("total") >= config.min_observations).alias("sufficient"),
        "mean",
        "sd",
    )


def _method_weights(routes: DataFrame, methods: tuple[Method, ...], traffic: DataFrame) -> DataFrame:
    """Weights per method: by rule for the routes its pool observed, or the traffic table."""

    def tag(i: int, m: Method) -> Column:
        return F.struct(F.lit(m.label).alias("label"), F.lit(m.aggregation).alias("aggregation"), F.lit(i).alias("position"))

    simple = [(i, m) for i, m in enumerate(methods) if m.weights != "traffic"]
    mine = F.array_compact(F.array(*[F.when(F.col("pool") == (m.horizon or "all"), tag(i, m)) for i, m in simple]))
    ends = F.split("route", "-", 2)
    rows = routes.select(F.explode(mine).alias("m"), ends[0].alias("origin"), ends[1].alias("destination"))
    uniform = F.col("label").isin([m.label for _, m in simple if m.weights == "uniform"])
    weight = F.when(uniform, 1.0).otherwise(metro_weight(F.col("origin"), F.col("destination")))
    plain = rows.select("m.*", "origin", "destination").withColumn("weight", weight)
    tagged = [tag(i, m) for i, m in enumerate(methods) if m.weights == "traffic"]
    if not tagged:
        return plain
    given = traffic.select("origin", "destination", "weight", F.explode(F.array(*tagged)).alias("m"))
    return plain.unionByName(given.select("m.*", "origin", "destination", "weight"))


def universe_comparison(index: PriceIndex, universes: DataFrame, current_period: str) -> DataFrame:
    """Index, changes and traffic coverage of one month per route set.

    `universes` has label, origin, destination (codes) and national_weight. Weights are
    renormalised inside each set, and routes outside it do not count.
    """
    facts = stage(index.facts, "route-month-facts")
    labelled = universes.withColumn("route", C.route_of(F.col("origin"), F.col("destination")))
    mine = facts.join(labelled.select("label", "route"), "route")
    weights = labelled.select("label", "origin", "destination", F.col("national_weight").alias("weight"))
    by = ("label",)
    start = C.period_ord(current_period) - 12
    rows = indices.route_indices(mine, index.config, C.ord_period(start), current_period, weights, by)
    monthly = indices.national_index(rows, index.config, by).filter(F.col("period") == current_period)
    sets = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("routes"), F.sum("national_weight").alias("traffic_coverage")
    )
    return sets.join(monthly, "label", "left").select(
        "label", "routes", "national_index", "mom_change_pct", "yoy_change_pct", "routes_covered", "traffic_coverage"
    )
