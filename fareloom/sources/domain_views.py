"""The analytical tables of the test warehouse seen as fare observations, traffic, calls and news.

Line items play quotes: supplier place is the origin, customer place the destination, the ship
date the flight date. The same definitions exist as SQL in `catalog.views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AIRPORTS

REGION_CODES = ("DEL", "BOM", "BLR", "MAA", "CCU")
NATION_CODES = tuple(code for code, *_ in AIRPORTS)
NATION_CITIES = tuple(city for _, city, *_ in AIRPORTS)
CARRIERS = ("IndiGo", "Air India", "SpiceJet", "Vistara", "Akasa Air")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], position: Column) -> Column:
    """values[position] as a chain of literals in generated code."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def _line_items(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Line items with their fare, in whole cents, and the codes of both ends.

    Customers join the orders first, so that line items are shuffled once, by order, with their fare in place of its parts. Regions
    follow from the nations at the very rows, as a join of two dimensions has no measured size and would be shuffled; small dimensions
    are broadcast by theirs.
    """

    def end(rows: DataFrame, place: str, out: str) -> DataFrame:
        if level != "region":
            return rows.withColumn(out, pick(NATION_CODES, F.col(place)))
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(place), F.col("n_regionkey").alias("region"))
        return rows.join(nation, place).withColumn(out, pick(REGION_CODES, F.col("region"))).drop("region")

    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    cents = F.floor(price * 100 + 0.5) / 100
    fare = cents * F.when(F.col("l_partkey") % 97 == 0, 6.0).otherwise(1.0)
    items = table(spark, sf_dir, "lineitem").withColumn("l_fare", fare)
    orders = end(orders.join(customer, orders["o_custkey"] == customer["c_custkey"]), "c_nationkey", "destination")
    items = end(items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"]), "s_nationkey", "origin")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"])


def _fare() -> Column:
    return F.col("l_fare")


def _airline() -> Column:
    slot = F.col("l_suppkey") % 6
    brand = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25 + 1).cast("string"))
    return F.when(slot == 5, brand).otherwise(pick(CARRIERS, F.least(slot, F.lit(4))))


def fares(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Well-formed quotes between region (5 metro codes) or nation (25 codes) pairs."""
    flight = F.col("l_shipdate").cast("date")
    parts = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return _line_items(spark, sf_dir, level).select(
        F.concat_ws("-", *[F.col(p).cast("string") for p in parts]).alias("observation_id"),
        _airline().alias("airline"),
        "origin",
        "destination",
        flight.alias("flight_date"),
        F.date_sub(flight, (F.col("l_partkey") % 75).cast("int")).alias("booking_date"),
        _fare().alias("total_fare"),
        F.lit("INR").alias("currency"),
    )


def fares_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with planted defects, text dates, repeated ids and optional columns."""
    part = F.col("l_partkey")

    def unless(divisor: int, value: Column, bad: Column) -> Column:
        return F.when(part % divisor == 0, bad).otherwise(value)

    null = F.lit(None).cast("string")
    obs_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    day = lambda date: date.cast("date").cast("string")
    ship, order = day(F.col("l_shipdate")), day(F.col("o_orderdate"))
    # A third of the quotes are booked a few days ahead, the others on the order date.
    booked = F.when(
        F.col("l_linenumber") <= 4, day(F.date_sub(F.col("l_shipdate").cast("date"), (part % 75).cast("int")))
    ).otherwise(order)
    origin = F.when((F.col("l_linenumber") == 7) & (part % 11 == 0), F.lit(" ")).otherwise(F.col("origin"))
    origin = unless(83, origin, F.lit("X1"))
    origin = unless(89, origin, F.lit("zzz"))
    fare = F.when(part % 79 == 0, -_fare()).otherwise(_fare())
    currency = F.when(F.col("l_suppkey") % 17 == 0, "USD").otherwise("INR")
    return _line_items(spark, sf_dir, "region").select(
        unless(61, obs_id, F.lit("")).alias("observation_id"),
        unless(53, _airline(), null).alias("airline"),
        origin.alias("origin"),
        unless(59, F.col("destination"), null).alias("destination"),
        unless(71, ship, F.lit("not-a-date")).alias("flight_date"),
        unless(73, booked, F.lit("")).alias("booking_date"),
        fare.alias("total_fare"),
        unless(67, currency, F.lit(" ")).alias("currency"),
        order.alias("timestamp"),
        F.col("l_returnflag").alias("source"),
        unless(5, F.lit("Economy"), null).alias("fare_class"),
    )


def fares_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes on few carriers and dates, so that near-equal fares meet in one group."""
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    base = fares_dirty_columns()
    return _line_items(spark, sf_dir, "region").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"),
        pick(CARRIERS, F.col("l_suppkey") % 2).alias("airline"),
        "origin",
        "destination",
        month.cast("string").alias("flight_date"),
        F.date_sub(month, 30).cast("string").alias("booking_date"),
        _fare().alias("total_fare"),
        F.lit("INR").alias("currency"),
        F.col("o_orderdate").cast("date").cast("string").alias("timestamp"),
        F.col("l_returnflag").alias("source"),
        F.lit("Economy").alias("fare_class"),
    ).select(*base)


def fares_dirty_columns() -> list[str]:
    return [
        "observation_id", "airline", "origin", "destination", "flight_date", "booking_date", "total_fare",
        "currency", "timestamp", "source", "fare_class",
    ]


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly passengers per city pair, both directions in one row."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", pick(NATION_CITIES, F.col("s_nationkey")).alias("a"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", pick(NATION_CITIES, F.col("c_nationkey")).alias("b"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])  # so that line items are shuffled once
    legs = items.join(supplier, items["l_suppkey"] == supplier["s_suppkey"]).join(placed, items["l_orderkey"] == placed["o_orderkey"])
    forward = F.col("a") <= F.col("b")
    return legs.groupBy(
        F.year("o_orderdate").alias("Year"),
        F.month("o_orderdate").alias("Month"),
        F.least("a", "b").alias("City1"),
        F.greatest("a", "b").alias("City2"),
    ).agg(
        F.sum(F.when(forward, F.col("l_quantity")).otherwise(0.0)).alias("PaxToCity2"),
        F.sum(F.when(~forward, F.col("l_quantity")).otherwise(0.0)).alias("PaxFromCity2"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of source calls: one row per request with its outcome."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "SUCCESS")
        .when(kind == "error", "HTTP_ERROR")
        .when(kind == "click", "EMPTY_RESULT")
        .when(kind == "view", "TIMEOUT")
        .otherwise("RATE_LIMITED")
    )
    user = F.col("user_id")
    route = F.concat_ws("-", pick(NATION_CODES, user % 25), pick(NATION_CODES, (user * 7 + 3) % 25))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.concat(F.lit("source_"), (user % 5).cast("string")).alias("source"),
        route.alias("route"),
        status.alias("status"),
        F.when(status == "SUCCESS", F.col("event_id") % 4 + 1).otherwise(0).alias("n_observations"),
        F.col("ts").cast("timestamp").alias("called_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: dated, tagged with airports and a route by document number."""
    doc = F.col("doc_id")
    a, b = pick(REGION_CODES, doc % 5), pick(REGION_CODES, F.floor(doc / 5) % 5)
    tagged = doc % 3 != 0
    none = F.array().cast("array<string>")
    # the first sentence that isn't blank, or the whole text where there is none
    first = F.regexp_extract("text", r"[^.]*[^.\x20\x09-\x0D][^.]*", 0)
    headline = F.regexp_replace(F.when(first != "", first).otherwise(F.col("text")), r"\s+", " ")
    return table(spark, sf_dir, "documents").select(
        headline.alias("headline"),
        F.col("source"),
        F.timestamp_add("DAY", (doc % 700).cast("int"), F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("published_at"),
        F.concat(F.lit("https://news.example.org/a/"), F.floor(doc / 2).cast("string")).alias("url"),
        F.when(tagged, F.array(a)).otherwise(none).alias("related_airports"),
        F.when(doc % 4 == 0, F.array(F.concat_ws("-", b, a))).otherwise(none).alias("related_routes"),
        F.when(doc % 2 == 0, F.array(pick(CARRIERS, doc % 5))).otherwise(none).alias("related_airlines"),
        F.col("text").alias("body"),
        doc.alias("doc_id"),
    )
