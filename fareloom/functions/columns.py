"""Column expressions shared by the operators: all built-in, all inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BOOKING_WINDOWS, HORIZON_BUCKETS


# --- Months ------------------------------------------------------------------------------------


def month_ord(date: Column) -> Column:
    """Calendar month as one integer, so that month arithmetic is plain addition."""
    return F.year(date) * 12 + F.month(date)


def period_text(ordinal: Column) -> Column:
    """`YYYY-MM` for a month ordinal, null for null."""
    zero_based = ordinal - 1
    text = F.format_string("%04d-%02d", F.floor(zero_based / 12).cast("int"), (zero_based % 12 + 1).cast("int"))
    return F.when(ordinal.isNotNull(), text)


def period_ord(period: str) -> int:
    """Month ordinal of a `YYYY-MM` text given on the driver."""
    year, _, month = period.partition("-")
    if len(year) != 4 or len(month) != 2 or not (year + month).isdigit() or not 1 <= int(month) <= 12:
        raise ValueError(f"not a YYYY-MM period: {period!r}")
    return int(year) * 12 + int(month)


def ord_period(ordinal: int) -> str:
    return f"{(ordinal - 1) // 12:04d}-{(ordinal - 1) % 12 + 1:02d}"


def shift_period(period: str, months: int) -> str:
    return ord_period(period_ord(period) + months)


def period_ord_of(text: Column) -> Column:
    """Month ordinal of a `YYYY-MM` column; null when malformed."""
    ok = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.substring(text, 1, 4).try_cast("int") * 12 + F.substring(text, 6, 2).try_cast("int"))


# --- Parsing -----------------------------------------------------------------------------------


def as_date(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """Column `name` as a date; unreadable text becomes null, extra formats are tried in order."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if not isinstance(kind, T.StringType):
        return c.cast("date")
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries).cast("date")


def as_instant(df: DataFrame, name: str) -> Column:
    """Column `name` as a timestamp; text without an offset counts as UTC."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(c)
    return c.cast("timestamp")


def as_number(c: Column) -> Column:
    """As double; text that is no number and NaN both become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds; a null test counts as not holding."""
    chain = None
    for code, test in rules:
        chain = F.when(test, F.lit(code)) if chain is None else chain.when(test, F.lit(code))
    return chain


# --- Domain expressions ------------------------------------------------------------------------


def route_of(origin: Column, destination: Column) -> Column:
    return F.concat_ws("-", F.upper(origin), F.upper(destination))


def band(value: Column, bands: Sequence[tuple[str, int, int | None]], otherwise: str | None) -> Column:
    """Label of the inclusive day band that holds `value`."""
    rules = [(label, (value >= lo) if hi is None else value.between(lo, hi)) for label, lo, hi in bands]
    out = first_reason(rules)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def horizon_bucket(days: Column) -> Column:
    return band(days, HORIZON_BUCKETS, "unknown")


def booking_window(days: Column) -> Column:
    return band(days, BOOKING_WINDOWS, None)


def advance_days(flight: Column, booking: Column) -> Column:
    """Days between two strict ISO date texts; anything else is null."""
    iso = r"^\d{4}-\d{2}-\d{2}$"
    strict = flight.cast("string").rlike(iso) & booking.cast("string").rlike(iso)
    return F.when(strict, F.datediff(flight.try_cast("date"), booking.try_cast("date")))


def pct_change(now: Column, before: Column) -> Column:
    return (F.try_divide(now, before) - 1.0) * 100.0


def in_order(code_tests: Sequence[tuple[str, Column]]) -> Column:
    """Array of the codes whose test holds, in the given order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in code_tests]))
