"""Conditions on data that raise while a query runs, as part of its plan and without an action of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


def refuse(df: DataFrame, broken: Column, message: Column) -> DataFrame:
    """The rows of `df`; a row for which `broken` holds fails the query with `message`.

    A filter, not a column: no later projection can prune it away.
    """
    return df.filter(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))


def guarded(df: DataFrame, checks: DataFrame) -> DataFrame:
    """The rows of `df`; a row of `checks` whose `problem` isn't null fails the query with it.

    `checks` becomes a branch of the plan that gives no rows: it is read even where `df` turns out to be empty. The rows it
    doesn't give are unpacked from an empty array, so that no later filter can prove the branch empty and remove it.
    """
    none = T.ArrayType(df.schema)
    rows = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast(none)).otherwise(F.array().cast(none))
    return df.unionByName(checks.select(F.explode(rows).alias("row")).select("row.*"))


def contiguous(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of `df`; a key that skips or repeats a calendar month fails the query.

    The window is the one that forecasts use, so the check shares their sort and costs no exchange.
    """
    before = F.lag("month_ord").over(W.partitionBy(*keys).orderBy("month_ord"))
    work = df.withColumn("month_before", before)
    who = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]) if keys else F.lit("the series")
    message = F.concat(
        F.lit("not calendar-complete: "), who, F.lit(" goes from "), C.period_text(F.col("month_before")), F.lit(" to "),
        C.period_text(F.col("month_ord")),
    )
    return refuse(work, F.col("month_ord") - F.col("month_before") != 1, message).drop("month_before")


def known(df: DataFrame, column: str, value: str, among: DataFrame | None = None) -> DataFrame:
    """Rows of one key; a key that doesn't occur in `df` (or in `among`) fails the query."""
    found = (among if among is not None else df).agg(F.count_if(F.col(column) == value).alias("n"))
    problem = F.when(F.col("n") == 0, F.lit(f"unknown {column}: {value!r}"))
    return guarded(df.filter(F.col(column) == value), found.select(problem.alias("problem")))
