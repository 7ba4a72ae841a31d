"""Coverage planning over ranked city pairs (at most cities squared rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import TIER_LABELS, TRUNK_CITIES
from ..functions import columns as C

TIER_CUTOFFS = (20, 50, 100)


def rank_routes(weights: DataFrame) -> DataFrame:
    """Rank by national weight, ties by city names, with the running coverage."""
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("national_weight"), "origin", "destination")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return weights.withColumns(
        {
            "rank": F.row_number().over(order),
            "cumulative_coverage": F.sum("national_weight").over(running),
        }
    )


def coverage_scenarios(ranked: DataFrame, counts: Sequence[int]) -> DataFrame:
    """Coverage of the top n for every n, and the gain over the next smaller n."""
    ns = sorted(counts)
    tops = ranked.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("rank") <= n, F.col("national_weight"))), F.lit(0.0)).alias(f"c{i}")
            for i, n in enumerate(ns)
        ]
    )
    rows = [
        F.struct(
            F.lit(n).alias("routes"),
            F.col(f"c{i}").alias("traffic_coverage"),
            (F.col(f"c{i}") - (F.col(f"c{i - 1}") if i else F.lit(0.0))).alias("incremental_gain"),
        )
        for i, n in enumerate(ns)
    ]
    return tops.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def coverage_at(ranked: DataFrame, n: int) -> DataFrame:
    return coverage_scenarios(ranked, [n]).select("routes", "traffic_coverage")


def target_table(ranked: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Fewest top routes that reach each target; 0 for a target of 0, null if it is out of reach."""

    def needed(t: float) -> Column:
        if t <= 0:
            return F.lit(0)
        return F.min(F.when(F.col("cumulative_coverage") >= t, F.col("rank")))

    found = ranked.agg(*[needed(t).alias(f"t{i}") for i, t in enumerate(targets)])
    rows = [
        F.struct(F.lit(float(t)).alias("target_coverage"), F.col(f"t{i}").alias("minimum_routes"))
        for i, t in enumerate(targets)
    ]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def bidirectional_summary(ranked: DataFrame) -> DataFrame:
    """Both directions of a pair together, ranked.

    The rank goes by passengers, to which the weight is proportional: their sums are exact, so
    equal pairs stay equal and fall back to their names.
    """
    pair = F.concat_ws(" <-> ", F.least("origin", "destination"), F.greatest("origin", "destination"))
    both = ranked.groupBy(pair.alias("city_pair")).agg(
        F.sum("passengers").alias("passengers"), F.sum("national_weight").alias("national_weight")
    )
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("passengers"), "city_pair")
    return both.withColumn("rank", F.row_number().over(order))


def assign_tiers(ranked: DataFrame, cutoffs: tuple[int, int, int] = TIER_CUTOFFS) -> DataFrame:
    rank = F.col("rank")
    tier = F.when(rank <= cutoffs[0], 1).when(rank <= cutoffs[1], 2).when(rank <= cutoffs[2], 3).otherwise(4)
    label = C.first_reason([(text, F.col("tier") == number) for number, text in TIER_LABELS])
    return ranked.withColumn("tier", tier).withColumn("tier_label", label)


def mark_covered(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    seen = pairs.select("origin", "destination").distinct().withColumn("seen", F.lit(True))
    joined = ranked.join(seen, ["origin", "destination"], "left")
    return joined.withColumn("currently_covered", F.coalesce("seen", F.lit(False))).drop("seen")


def city_traffic(pairs: DataFrame) -> DataFrame:
    """Passengers touching each city, both directions, ranked. The pairs are read once."""
    ends = pairs.select(F.explode(F.array("origin", "destination")).alias("city"), "passengers")
    totals = ends.groupBy("city").agg(F.sum("passengers").alias("passengers"))
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("passengers"), "city")
    return totals.withColumn("rank", F.row_number().over(order))


def underrepresented_cities(cities: DataFrame, ranked: DataFrame, top_cities: int = 30, top_routes: int = 100) -> DataFrame:
    """Busy cities none of whose routes is among the top routes."""
    chosen = ranked.filter(F.col("rank") <= top_routes)
    served = chosen.select(F.explode(F.array("origin", "destination")).alias("city")).distinct()
    return cities.filter(F.col("rank") <= top_cities).join(served, "city", "left_anti")


def route_priority(tiered: DataFrame, top_n: int = 150, source: str = "TRAFFIC_DERIVED_ROUTE_PRIORITY") -> DataFrame:
    """The table handed to collection planning: top routes with tier, pair and reason."""
    trunk = F.col("origin").isin(*TRUNK_CITIES) & F.col("destination").isin(*TRUNK_CITIES)
    return tiered.filter(F.col("rank") <= top_n).select(
        F.col("rank").alias("priority_rank"),
        "tier",
        "tier_label",
        "origin",
        "destination",
        F.concat_ws(" <-> ", "origin", "destination").alias("city_pair"),
        "passengers",
        "national_weight",
        "cumulative_coverage",
        "currently_covered",
        (F.col("tier") <= 3).alias("recommended"),
        F.when(trunk, "core metro trunk route").otherwise("high-traffic route").alias("geographic_reason"),
        F.lit(source).alias("source"),
    )


def recommended_routes(tiered: DataFrame, cities: DataFrame, top_n: int = 100) -> DataFrame:
    """Top routes with airport codes, null where either city has no verified code."""
    out = tiered.filter(F.col("rank") <= top_n)
    for end in ("origin", "destination"):
        lookup = cities.select(F.col("city").alias(f"{end}_key"), F.col("code").alias(f"{end}_code"))
        out = out.join(lookup, out[end] == lookup[f"{end}_key"], "left").drop(f"{end}_key")
    both = F.col("origin_code").isNotNull() & F.col("destination_code").isNotNull()
    return out.select(
        F.col("origin").alias("origin_city"),
        F.col("destination").alias("destination_city"),
        F.when(both, F.col("origin_code")).alias("origin_iata"),
        F.when(both, F.col("destination_code")).alias("destination_iata"),
        F.col("rank").alias("priority"),
        "tier",
        "national_weight",
        "currently_covered",
    )
