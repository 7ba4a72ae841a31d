"""Top lists, movers, paging and the joined route views. Inputs have one row per route and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import AIRPORTS

# List name, metric column, largest first.
RANKINGS = (
    ("highest_mom_inflation", "mom_inflation_pct", True),
    ("lowest_mom_inflation", "mom_inflation_pct", False),
    ("highest_yoy_inflation", "yoy_inflation_pct", True),
    ("lowest_yoy_inflation", "yoy_inflation_pct", False),
    ("largest_positive_contributors", "contribution", True),
    ("largest_negative_contributors", "contribution", False),
    ("highest_traffic_weight", "traffic_weight", True),
    ("highest_volatility", "volatility", True),
)


def top_rankings(inflation: DataFrame, n: int = 5) -> DataFrame:
    """All eight lists of every month in one pass: (period, list, rank, route, value)."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("list"), F.col(metric).alias("value"), F.lit(1 if down else -1).alias("sign"))
            for name, metric, down in RANKINGS
        ]
    )
    long = inflation.select("period", "route", F.explode(entries).alias("e")).select("period", "route", "e.*")
    order = W.partitionBy("period", "list").orderBy(F.desc(F.col("value") * F.col("sign")), "route")
    ranked = long.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("period", "list", "rank", "route", "value")


def movers(inflation: DataFrame, n: int = 3) -> DataFrame:
    """Largest rises and falls and top contributors of each month; a missing contribution ranks last."""
    month = W.partitionBy("period")
    ranked = inflation.withColumns(
        {
            "up": F.row_number().over(month.orderBy(F.desc_nulls_last("mom_inflation_pct"), "route")),
            "down": F.row_number().over(month.orderBy(F.asc_nulls_last("mom_inflation_pct"), "route")),
            "gain": F.row_number().over(month.orderBy(F.desc_nulls_last("contribution"), "route")),
        }
    )
    has_mom = F.col("mom_inflation_pct").isNotNull()
    lists = F.array_compact(
        F.array(
            _slot("increase", F.col("up"), F.col("mom_inflation_pct"), has_mom, n),
            _slot("decrease", F.col("down"), F.col("mom_inflation_pct"), has_mom, n),
            _slot("contributor", F.col("gain"), F.col("contribution"), F.lit(True), n),
        )
    )
    return ranked.select("period", "route", F.explode(lists).alias("e")).select("period", "e.*", "route")


def _slot(name: str, rank: Column, value: Column, allowed: Column, n: int) -> Column:
    entry = F.struct(F.lit(name).alias("list"), rank.alias("rank"), value.alias("value"))
    return F.when(allowed & (rank <= n), entry)


def page(df: DataFrame, limit: int = 50, offset: int = 0, order: tuple[str, ...] = ("period",)) -> DataFrame:
    """One page in order, with the total and whether more follow. The limit is clamped to 1..500."""
    size, skip = max(1, min(500, limit)), max(0, offset)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*order).offset(skip).limit(size)
    return rows.withColumn("total", total).withColumn("has_more", F.col("total") > skip + size)


def sort_nulls_last(df: DataFrame, key: str, direction: str = "desc") -> DataFrame:
    order = F.desc_nulls_last(key) if direction == "desc" else F.asc_nulls_last(key)
    return df.orderBy(order, "route")


def max_abs(df: DataFrame, metric: str) -> DataFrame:
    """Largest absolute value per month, 1 where there is none: the scale of a colour axis."""
    return df.groupBy("period").agg(F.coalesce(F.max(F.abs(metric)), F.lit(1.0)).alias("max_abs"))


def airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(code, lat, lon) for code, _, lat, lon in AIRPORTS], "code string, lat double, lon double"
    )


def map_objects(inflation: DataFrame, places: DataFrame) -> DataFrame:
    """Routes with coordinates at both ends; a route with an unknown end is left out."""
    a = places.select(F.col("code").alias("origin"), F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"))
    b = places.select(
        F.col("code").alias("destination"), F.col("lat").alias("destination_lat"), F.col("lon").alias("destination_lon")
    )
    return (
        inflation.join(a, "origin")
        .join(b, "destination")
        .select(
            "period", "origin", "destination", "origin_lat", "origin_lon", "destination_lat", "destination_lon",
            F.col("mom_inflation_pct").alias("inflation_mom"),
            F.col("yoy_inflation_pct").alias("inflation_yoy"),
            "volatility", "traffic_weight", "contribution", "status",
        )
    )


def title_case(city: Column) -> Column:
    return F.regexp_replace(F.initcap(F.lower(city)), r"\bAnd\b", "and")


def route_detail(inflation: DataFrame, volatility: DataFrame, places: DataFrame, planned: DataFrame) -> DataFrame:
    """Everything known about a route in a month: index, change, spread, coordinates, plan."""
    spread = volatility.select("route", "month_ord", F.col("classification").alias("volatility_class"))
    a = places.select(F.col("code").alias("o"), F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"))
    b = places.select(
        F.col("code").alias("d"), F.col("lat").alias("destination_lat"), F.col("lon").alias("destination_lon")
    )
    coords = a.withColumn("has_o", F.lit(True)), b.withColumn("has_d", F.lit(True))
    plan = planned.filter(F.col("origin_iata").isNotNull()).select(
        F.concat_ws("-", "origin_iata", "destination_iata").alias("route"),
        title_case(F.col("origin_city")).alias("origin_city"),
        title_case(F.col("destination_city")).alias("destination_city"),
        "priority",
        "tier",
    )
    out = (
        inflation.join(spread, ["route", "month_ord"], "left")
        .join(coords[0], F.col("origin") == F.col("o"), "left")
        .join(coords[1], F.col("destination") == F.col("d"), "left")
        .join(plan, "route", "left")
    )
    mapped = F.col("has_o") & F.col("has_d")
    both = {c: F.when(mapped, F.col(c)) for c in ("origin_lat", "origin_lon", "destination_lat", "destination_lon")}
    return out.withColumns(both).drop("o", "d", "has_o", "has_d")


def contribution_breakdown(inflation: DataFrame) -> DataFrame:
    """Routes with a contribution: side, rank on that side, rank by size, the month's scale and drops."""
    month = W.partitionBy("period")
    c = F.col("contribution")
    side = F.when(c > 0, "positive").when(c < 0, "negative").otherwise("zero")
    work = inflation.withColumns(
        {
            "side": side,
            "dropped_no_value": F.count_if(c.isNull()).over(month),
            "scale": F.max(F.abs(c)).over(month),
        }
    ).filter(c.isNotNull())
    by_side = W.partitionBy("period", "side").orderBy(F.desc(F.abs("contribution")), "route")
    by_size = month.orderBy(F.desc(F.abs("contribution")), "route")
    return work.withColumns({"side_rank": F.row_number().over(by_side), "rank": F.row_number().over(by_size)})


def dashboard_coverage(listing: DataFrame) -> DataFrame:
    """Routes, active routes and their mean weight per month."""
    active = F.col("status") == "active"
    mean = F.avg(F.when(active, F.col("traffic_coverage")))
    return listing.groupBy("period").agg(
        F.count(F.lit(1)).alias("total_routes"),
        F.count_if(active).alias("active_routes"),
        F.coalesce(F.round(mean, 4), F.lit(0.0)).alias("average_coverage"),
    )
