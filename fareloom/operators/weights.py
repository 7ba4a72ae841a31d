"""Route weights: in force at a period, normalised, or derived from the metro rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import METROS
from ..functions import columns as C
from .constraints import refuse


def with_defaults(weights: DataFrame) -> DataFrame:
    """Route, upper-case codes, open validity and source where the table lacks them."""
    missing = [c for c in ("origin", "destination", "weight") if c not in weights.columns]
    if missing:
        raise ValueError(f"weights lack columns: {missing}")
    out = weights.withColumns({"origin": F.upper("origin"), "destination": F.upper("destination")})
    out = out.withColumn("route", C.route_of(F.col("origin"), F.col("destination")))
    for name, value in (
        ("effective_from", F.lit(None).cast("date")),
        ("effective_to", F.lit(None).cast("date")),
        ("source", F.lit("UNSPECIFIED")),
    ):
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out


def _swept(weights: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Column]:
    """Rows with `taken_until`, and the test that a row begins before that.

    A sweep over the rows of a route by their first day: the running maximum of the last days tells for how long the route is
    taken. A row of an open beginning starts first, one of an open end never ends; a range that ends before it begins is in
    force on no day. Both ends of a range are in it. A route has few rows, one per change of its weight.
    """
    start = F.coalesce(F.col("effective_from").cast("date"), F.lit("0001-01-01").cast("date"))
    end = F.coalesce(F.col("effective_to").cast("date"), F.lit("9999-12-31").cast("date"))
    earlier = W.partitionBy(*by, "route").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    swept = with_defaults(weights).withColumn("taken_until", F.max(F.when(start <= end, end)).over(earlier))
    return swept, (start <= end) & (start <= F.col("taken_until"))


def overlapping(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of a route that begin while an earlier row of the route is in force, with the day that one ends."""
    swept, taken = _swept(weights, by)
    return swept.filter(taken)


def one_in_force(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The weights with defaults; two rows of a route in force on one day fail the query, or the route would count twice."""
    swept, taken = _swept(weights, by)
    since = F.coalesce(F.col("effective_from").cast("string"), F.lit("the start"))
    text = F.concat(F.lit("weights of "), F.col("route"), F.lit(" overlap from "), since)
    return refuse(swept, taken, text).drop("taken_until")


def weights_for_period(weights: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows in force on the first day of `period`; an open end is always in force. Overlapping rows fail the query."""
    day = F.lit(f"{period}-01").cast("date")
    w = one_in_force(weights, by)
    start, end = F.col("effective_from").cast("date"), F.col("effective_to").cast("date")
    return w.filter((start.isNull() | (start <= day)) & (end.isNull() | (end >= day)))


def weights_for_periods(weights: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows in force for each of many periods (column `month_ord`). Overlapping rows fail the query.

    A validity range is turned into the months it covers within the given periods, which makes
    the range join an equi-join on the month.
    """
    w = one_in_force(weights)
    span = periods.agg(F.min("month_ord").alias("lo"), F.max("month_ord").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    start, end = F.col("effective_from").cast("date"), F.col("effective_to").cast("date")
    # Months whose first day lies in [from, to].
    first = F.when(F.dayofmonth(start) > 1, C.month_ord(start) + 1).otherwise(C.month_ord(start))
    begin = F.greatest(F.coalesce(first, lo), lo)
    finish = F.least(F.coalesce(C.month_ord(end), hi), hi)
    covered = F.when(begin <= finish, F.sequence(begin, finish))
    return w.withColumn("month_ord", F.explode(covered)).join(periods.select("month_ord").distinct(), "month_ord")


def normalize(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """weight over the total of the table (or of each `by` group).

    The total of a whole table is a one-row subquery over the weights alone, so wide rows stay where they are.
    """
    total = F.sum("weight").over(W.partitionBy(*by)) if by else weights.agg(F.sum("weight")).scalar()
    return weights.withColumn("weight_normalized", F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)))


def one_per_route(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lookup table of the rows in force, one per route."""
    latest = F.max(F.struct("effective_from", "effective_to", "weight", "weight_normalized"))
    return (
        weights.groupBy(*by, "route")
        .agg(latest.alias("w"))
        .select(*by, "route", "w.weight", "w.weight_normalized")
    )


def metro_weight(origin: Column, destination: Column) -> Column:
    """3 between two metros, else 1: an illustrative weight for data that comes with none."""
    return F.when(origin.isin(*METROS) & destination.isin(*METROS), F.lit(3.0)).otherwise(F.lit(1.0))


def metro_weights(routes: DataFrame, source: str = "SYNTHETIC_DEMO_ONLY") -> DataFrame:
    """Weights table for the distinct `route`s of a table."""
    parts = F.split("route", "-", 2)
    return (
        routes.select("route")
        .distinct()
        .select(parts[0].alias("origin"), parts[1].alias("destination"))
        .withColumns(
            {
                "weight": metro_weight(F.col("origin"), F.col("destination")),
                "effective_from": F.lit(None).cast("date"),
                "effective_to": F.lit(None).cast("date"),
                "source": F.lit(source),
            }
        )
    )
