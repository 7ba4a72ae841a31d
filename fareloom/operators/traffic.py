"""Passenger traffic: validation, directed pairs, windows and the weights derived from them.

After `aggregate` a table has one row per directed city pair, at most the square of the number
of cities, so the totals and ranks below run over small tables by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import AIRPORTS
from ..functions import columns as C
from ..session import stage
from .weights import metro_weights

REQUIRED = ("Year", "Month", "City1", "City2", "PaxToCity2", "PaxFromCity2")
RECORD_KEY = ("Year", "Month", "City1", "City2")


def _checked(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"traffic lacks columns: {missing}")
    city = lambda name: F.upper(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("NAN"))))
    work = df.withColumns(
        {
            "Year": C.as_number(F.col("Year")),
            "Month": C.as_number(F.col("Month")),
            "PaxToCity2": C.as_number(F.col("PaxToCity2")),
            "PaxFromCity2": C.as_number(F.col("PaxFromCity2")),
            "City1": city("City1"),
            "City2": city("City2"),
        }
    )
    no_city = ("", "NAN", "NONE")
    bad = lambda name: F.col(name).isNull() | (F.col(name) < 0)
    rules = [
        ("MISSING_CITY", F.col("City1").isin(*no_city) | F.col("City2").isin(*no_city)),
        ("SAME_ORIGIN_DESTINATION", F.col("City1") == F.col("City2")),
        ("INVALID_MONTH", F.col("Month").isNull() | ~F.col("Month").between(1, 12)),
        ("INVALID_YEAR", F.col("Year").isNull() | ~F.col("Year").between(1990, 2100)),
        ("INVALID_PASSENGER_COUNT", bad("PaxToCity2") | bad("PaxFromCity2")),
    ]
    return work.withColumn("rejection_reason", C.first_reason(rules))


def tally(df: DataFrame, order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Raw records in one pass: a row per valid (Year, Month, City1, City2), the first by `order_cols`, then by value, with its
    copies `n`; and a row per rejection reason with null keys. Combines before the shuffle, so no reason is a hot key."""
    work = _checked(df)
    good = F.col("rejection_reason").isNull()
    rest = [c for c in (*order_cols, *work.columns) if c not in (*RECORD_KEY, "rejection_reason")]
    keyed = work.withColumns({c: F.when(good, F.col(c)) for c in RECORD_KEY})
    grouped = keyed.groupBy("rejection_reason", *RECORD_KEY).agg(
        F.min(F.struct(*dict.fromkeys(rest))).alias("kept"), F.count(F.lit(1)).alias("n")
    )
    columns = [c for c in df.columns if c not in RECORD_KEY]
    return grouped.select("rejection_reason", *RECORD_KEY, *[F.col(f"kept.{c}").alias(c) for c in columns], "n")


def _valid(tallied: DataFrame) -> DataFrame:
    return tallied.filter(F.col("rejection_reason").isNull()).drop("rejection_reason", "n")


def validate_traffic(df: DataFrame, order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Usable records, one per (Year, Month, City1, City2): the first by `order_cols`, then by value."""
    return _valid(tally(df, order_cols)).select(*df.columns)


def _reasons(tallied: DataFrame) -> DataFrame:
    """(reason, n) of a tally: rejected records, and copies of valid ones beyond the first."""
    repeated = F.col("rejection_reason").isNull()
    reason = F.coalesce("rejection_reason", F.lit("DUPLICATE_TRAFFIC_RECORD"))
    amount = F.sum(F.col("n") - F.when(repeated, 1).otherwise(0))
    return tallied.groupBy(reason.alias("reason")).agg(amount.cast("long").alias("n")).filter(F.col("n") > 0)


def rejection_counts(df: DataFrame) -> DataFrame:
    """(reason, n); repeats of a valid record count as DUPLICATE_TRAFFIC_RECORD."""
    return _reasons(tally(df))


def to_directional(valid: DataFrame, source: str) -> DataFrame:
    """Two directed rows per record, from one scan."""
    ordinal = (F.col("Year") * 12 + F.col("Month")).cast("int")

    def leg(origin: str, destination: str, passengers: str) -> Column:
        return F.struct(
            F.col(origin).alias("origin"), F.col(destination).alias("destination"), F.col(passengers).alias("passengers")
        )

    legs = F.array(leg("City1", "City2", "PaxToCity2"), leg("City2", "City1", "PaxFromCity2"))
    return valid.select(ordinal.alias("month_ord"), F.explode(legs).alias("leg")).select(
        "month_ord", C.period_text(F.col("month_ord")).alias("period"), "leg.*", F.lit(source).alias("source")
    )


def latest_month(directed: DataFrame) -> Column:
    """Most recent month of the data as a scalar subquery."""
    return directed.agg(F.max("month_ord").alias("m")).scalar()


def rolling_window(end_period: str, months: int = 12) -> tuple[str, str]:
    return C.shift_period(end_period, -(months - 1)), end_period


def aggregate(directed: DataFrame, first: Column, last: Column) -> DataFrame:
    """Passengers per directed pair in an inclusive month range."""
    window = directed.filter(F.col("month_ord").between(first, last))
    return window.groupBy("origin", "destination").agg(F.sum("passengers").alias("passengers"))


def national_weights(pairs: DataFrame) -> DataFrame:
    total = F.sum("passengers").over(W.partitionBy(F.lit(1)))
    return pairs.withColumn("national_weight", F.coalesce(F.try_divide("passengers", total), F.lit(0.0)))


def covered_subset(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that quotes exist for, with weights renormalised among them."""
    covered = weights.join(pairs.select("origin", "destination").distinct(), ["origin", "destination"], "left_semi")
    total = F.sum("national_weight").over(W.partitionBy(F.lit(1)))
    share = F.coalesce(F.try_divide("national_weight", total), F.lit(0.0))
    return covered.withColumn("covered_normalized_weight", share)


def weight_coverage(covered: DataFrame) -> DataFrame:
    return covered.agg(F.coalesce(F.sum("national_weight"), F.lit(0.0)).alias("traffic_weight_coverage"))


def city_map(spark: SparkSession) -> DataFrame:
    """Verified code <-> city table: (code, city)."""
    return spark.createDataFrame([(code, city) for code, city, *_ in AIRPORTS], "code string, city string")


def to_city_pairs(routes: DataFrame, cities: DataFrame) -> DataFrame:
    """Code pairs as city pairs; a code outside the map fails the job with its name."""
    return _mapped(routes, cities, "code", "city").select(
        F.col("to_origin").alias("origin"), F.col("to_destination").alias("destination")
    )


def _mapped(df: DataFrame, cities: DataFrame, key: str, value: str) -> DataFrame:
    out = df
    for end in ("origin", "destination"):
        lookup = cities.select(F.col(key).alias(f"key_{end}"), F.col(value).alias(f"to_{end}"))
        out = out.join(lookup, F.upper(out[end]) == lookup[f"key_{end}"], "left").drop(f"key_{end}")
        problem = F.raise_error(F.concat(F.lit("no verified mapping for "), F.coalesce(F.col(end), F.lit("null"))))
        out = out.withColumn(f"to_{end}", F.coalesce(F.col(f"to_{end}"), problem.cast("string")))
    return out


def to_engine_weights(covered: DataFrame, cities: DataFrame, first: Column, last: Column, source: str) -> DataFrame:
    """Weights table of the index, in codes. Validity stays open; the measured window is kept apart."""
    return _mapped(covered, cities, "city", "code").select(
        F.col("to_origin").alias("origin"),
        F.col("to_destination").alias("destination"),
        F.col("covered_normalized_weight").alias("weight"),
        "national_weight",
        F.lit(None).cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        C.period_text(first).alias("weight_period_start"),
        C.period_text(last).alias("weight_period_end"),
        F.lit(source).alias("source"),
    )


def diagnostics(tallied: DataFrame, weights: DataFrame, covered: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row: window, sizes, coverage, rejected records and `rejection_reasons` (reason -> n)."""
    reasons = F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n"))))
    rejected = _reasons(tallied).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), reasons.alias("reasons"))
    covered_routes = covered.agg(F.count(F.lit(1)).alias("n")).scalar()
    return weights.agg(
        F.count(F.lit(1)).alias("total_routes_in_window"), F.sum("passengers").alias("total_passengers_in_window")
    ).withColumns(
        {
            "weight_period_start": C.period_text(first),
            "weight_period_end": C.period_text(last),
            "covered_routes": covered_routes,
            "traffic_weight_coverage": weight_coverage(covered).scalar(),
            "records_received": tallied.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar(),
            "records_rejected": rejected.select("n").scalar(),
            "rejection_reasons": rejected.select("reasons").scalar(),
        }
    )


def _covered(tallied: DataFrame, pairs: DataFrame, months: int, end_period: str | None):
    """(national weights, covered subset, first month, last month) of a window that ends at the latest month of the data."""
    directed = to_directional(_valid(tallied), "TRAFFIC")
    last = F.lit(C.period_ord(end_period)) if end_period else latest_month(directed)
    first = last - (months - 1)
    weights = stage(national_weights(aggregate(directed, first, last)), "traffic-weights")
    return weights, covered_subset(weights, pairs), first, last


def build_weights(
    df: DataFrame,
    covered_routes: DataFrame,
    months: int = 12,
    end_period: str | None = None,
    source: str = "TRAFFIC_DERIVED",
) -> tuple[DataFrame, DataFrame]:
    """(index weights, diagnostics) from raw traffic and the code pairs that quotes cover.

    The raw records are read once, into a staged tally of valid records and reasons, which all that follows reads. A code without a
    city fails the query.
    """
    cities = city_map(df.sparkSession)
    tallied = stage(tally(df), "traffic-tally")
    weights, covered, first, last = _covered(tallied, to_city_pairs(covered_routes, cities), months, end_period)
    return (
        to_engine_weights(covered, cities, first, last, source),
        diagnostics(tallied, weights, covered, first, last),
    )


def weights_or_metro(df: DataFrame, covered_routes: DataFrame, months: int = 12, end_period: str | None = None) -> DataFrame:
    """Traffic weights with `is_real`; the metro rule for all routes if one has an unmapped code or traffic covers none.

    The choice is made inside the plan, by two counts over the routes.
    """
    cities = city_map(df.sparkSession)
    routes = covered_routes.select(F.upper("origin").alias("origin"), F.upper("destination").alias("destination")).distinct()
    routes = stage(routes, "covered-routes")
    ends = routes.select(F.explode(F.array("origin", "destination")).alias("code")).distinct()
    unmapped = ends.join(cities, "code", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    named = routes
    for end in ("origin", "destination"):
        named = named.join(cities.select(F.col("code").alias(end), F.col("city").alias(f"{end}_city")), end)
    pairs = named.select(F.col("origin_city").alias("origin"), F.col("destination_city").alias("destination"))
    _, covered, first, last = _covered(stage(tally(df), "traffic-tally"), pairs, months, end_period)
    covered = stage(covered, "traffic-covered")
    usable = (unmapped == 0) & (covered.agg(F.count(F.lit(1)).alias("n")).scalar() > 0)
    columns = ["origin", "destination", "weight", "effective_from", "effective_to", "source"]
    real = to_engine_weights(covered, cities, first, last, "TRAFFIC_DERIVED").select(*columns, F.lit(True).alias("is_real"))
    rule = metro_weights(routes.select(C.route_of(F.col("origin"), F.col("destination")).alias("route")))
    return real.filter(usable).unionByName(rule.select(*columns, F.lit(False).alias("is_real")).filter(~usable))
