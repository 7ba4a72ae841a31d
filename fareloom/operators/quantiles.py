"""Exact order statistics of large, skewed groups.

A built-in `percentile` keeps one group's values in one task. Here a group is first reduced to
(value, count) pairs, which combine map-side, and the wanted ranks are then found in two levels:
counts per value bin tell which bin holds a rank, and only those bins are sorted. No task sees
more than the bins of one group (bounded by the value range over `BIN_WIDTH`) or the distinct
values of one bin (bounded by `BIN_WIDTH` over the price tick), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN_WIDTH = 16.0


def value_bin(value: str) -> Column:
    return F.floor(F.col(value) / BIN_WIDTH)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, bin, value, n): one row per distinct value of a group."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("bin", value_bin(value))
        .groupBy(*keys, "bin", value)
        .agg(amount.cast("long").alias("n"))
    )


def _bins(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per bin its rank range [start, stop) in the group, and the group's totals."""
    v, n = F.col(value), F.col("n")
    bins = counts.groupBy(*keys, "bin").agg(
        F.sum(n).alias("b_n"),
        F.sum(n * v).alias("b_sum"),
        F.sum(n * v * v).alias("b_sq"),
        F.min(v).alias("b_min"),
        F.max(v).alias("b_max"),
    )
    group = W.partitionBy(*keys)
    upto = group.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("stop", F.sum("b_n").over(upto)).withColumn("start", F.col("stop") - F.col("b_n"))
    for name, source, how in (
        ("total", "b_n", F.sum),
        ("g_sum", "b_sum", F.sum),
        ("g_sq", "b_sq", F.sum),
        ("g_min", "b_min", F.min),
        ("g_max", "b_max", F.max),
    ):
        bins = bins.withColumn(name, how(source).over(group))
    return bins


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]):
    test = None
    for name in names:
        one = left[name].eqNullSafe(right[f"r_{name}"])
        test = one if test is None else test & one
    return test


def _values_in(counts: DataFrame, bins: DataFrame, keys: Sequence[str], value: str, carry: Sequence[str]) -> DataFrame:
    """The distinct values that lie in `bins`, each with its rank range [lo, hi)."""
    names = [*keys, "bin"]
    right = bins.select(*[F.col(k).alias(f"r_{k}") for k in names], "start", *carry)
    inner = counts.join(right, _same(counts, right, names)).drop(*[f"r_{k}" for k in names])
    # Few bins per group are left, so one exchange on the group serves the window and what follows.
    inner = inner.repartition(*keys)
    within = W.partitionBy(*names).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return inner.withColumn("hi", F.col("start") + F.sum("n").over(within)).withColumn("lo", F.col("hi") - F.col("n"))


def exact_percentiles(
    counts: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str, moments: bool = False
) -> DataFrame:
    """One row per group: `total`, one column per entry of `probs` (linear interpolation).

    With `moments` also mean, sd (sample), g_min and g_max of the group.
    """
    bins = _bins(counts, keys, value)
    ranks = {}
    for name, q in probs.items():
        position = F.lit(float(q)) * (F.col("total") - 1).cast("double")
        ranks[name] = (position, F.floor(position), F.ceil(position))

    def holds(rank):
        return (F.col("start") <= rank) & (rank < F.col("stop"))

    wanted = None
    for _, low, high in ranks.values():
        test = holds(low) | holds(high)
        wanted = test if wanted is None else wanted | test
    carry = ["total", "g_sum", "g_sq", "g_min", "g_max"]
    values = _values_in(counts, bins.filter(wanted), keys, value, carry)

    aggs = [F.max(c).alias(c) for c in carry]
    for name, (_, low, high) in ranks.items():
        for tag, rank in (("lo", low), ("hi", high)):
            at_rank = F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col(value))
            aggs.append(F.max(at_rank).alias(f"{name}_{tag}"))
    grouped = values.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col("total")]
    for name, (position, low, _) in ranks.items():
        below, above = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((below + (above - below) * (position - low)).alias(name))
    if moments:
        out += _moment_columns()
    return grouped.select(*out)


def _moment_columns():
    total, g_sum, g_sq = F.col("total"), F.col("g_sum"), F.col("g_sq")
    spread = F.greatest(F.lit(0.0), g_sq - g_sum * g_sum / total)
    sd = F.when(F.col("g_min") == F.col("g_max"), F.lit(0.0)).otherwise(F.sqrt(F.try_divide(spread, total - 1)))
    return [
        (g_sum / total).alias("mean"),
        F.when(total > 1, sd).alias("sd"),
        F.col("g_min"),
        F.col("g_max"),
    ]


def group_moments(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """total, mean, sd, g_min, g_max per group, from value counts."""
    v, n = F.col(value), F.col("n")
    grouped = counts.groupBy(*keys).agg(
        F.sum(n).alias("total"),
        F.sum(n * v).alias("g_sum"),
        F.sum(n * v * v).alias("g_sq"),
        F.min(v).alias("g_min"),
        F.max(v).alias("g_max"),
    )
    return grouped.select(*keys, "total", *_moment_columns())


def trimmed_means(counts: DataFrame, keys: Sequence[str], share: float, value: str) -> DataFrame:
    """Mean after dropping floor(share * n) values from each end of the group.

    Bins that lie wholly inside the kept ranks count with their sum; only the bins the cut
    falls into are sorted.
    """
    bins = _bins(counts, keys, value)
    cut = F.floor(F.lit(float(share)) * F.col("total"))
    bins = bins.withColumn("keep_lo", cut).withColumn("keep_hi", F.col("total") - cut)
    inside = (F.col("start") >= F.col("keep_lo")) & (F.col("stop") <= F.col("keep_hi"))
    touched = (F.col("start") < F.col("keep_hi")) & (F.col("stop") > F.col("keep_lo"))
    whole = bins.filter(inside).select(*keys, F.col("b_sum").alias("part"), F.col("b_n").alias("kept"))
    edges = _values_in(counts, bins.filter(touched & ~inside), keys, value, ["keep_lo", "keep_hi"])
    overlap = F.greatest(
        F.lit(0), F.least(F.col("hi"), F.col("keep_hi")) - F.greatest(F.col("lo"), F.col("keep_lo"))
    )
    partial = edges.withColumn("kept", overlap).select(*keys, (F.col(value) * F.col("kept")).alias("part"), "kept")
    return (
        whole.unionByName(partial)
        .groupBy(*keys)
        .agg(F.try_divide(F.sum("part"), F.sum("kept")).alias("trimmed_mean"))
    )
