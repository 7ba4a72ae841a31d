"""Record rules of the index: one reason per rejected quote, and the derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..constants import REQUIRED_COLUMNS
from ..functions import columns as C


def with_rejection_reason(df: DataFrame, fare_field: str = "total_fare", formats: Sequence[str] = ()) -> DataFrame:
    """Parse dates and fare, and add `rejection_reason` (null = usable)."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    parsed = {
        "flight_date": C.as_date(df, "flight_date", formats),
        "booking_date": C.as_date(df, "booking_date", formats),
        "total_fare": C.as_number(F.col("total_fare")),
    }
    if fare_field != "total_fare" and fare_field in df.columns:
        parsed[fare_field] = C.as_number(F.col(fare_field))
    work = df.withColumns(parsed)
    fares = ["total_fare"] + [c for c in parsed if c == fare_field and c != "total_fare"]
    text = ("observation_id", "airline", "origin", "destination", "currency")
    rules = [
        ("MISSING_REQUIRED_FIELD", C.any_of(C.is_blank(F.col(c)) for c in text)),
        ("INVALID_DATE", F.col("flight_date").isNull() | F.col("booking_date").isNull()),
        ("INVALID_FARE", C.any_of(F.col(c).isNull() | (F.col(c) <= 0) for c in fares)),
        ("SAME_ORIGIN_DESTINATION", F.upper("origin") == F.upper("destination")),
        ("IMPOSSIBLE_BOOKING_HORIZON", F.datediff("flight_date", "booking_date") < 0),
    ]
    return work.withColumn("rejection_reason", C.first_reason(rules))


def validate(df: DataFrame, fare_field: str = "total_fare") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with their reason)."""
    work = with_rejection_reason(df, fare_field)
    reason = F.col("rejection_reason")
    return work.filter(reason.isNull()).drop("rejection_reason"), work.filter(reason.isNotNull())


def add_route(df: DataFrame) -> DataFrame:
    return df.withColumn("route", C.route_of(F.col("origin"), F.col("destination")))


def add_period(df: DataFrame) -> DataFrame:
    """The month of travel, as ordinal and as text."""
    ordinal = C.month_ord(F.col("flight_date"))
    return df.withColumn("month_ord", ordinal).withColumn("period", C.period_text(ordinal))


def add_booking_horizon(df: DataFrame) -> DataFrame:
    days = F.datediff("flight_date", "booking_date")
    return df.withColumn("booking_horizon_days", days).withColumn("booking_horizon_bucket", C.horizon_bucket(days))


def add_standardized_fare(df: DataFrame, fare_field: str) -> DataFrame:
    if fare_field not in df.columns:
        raise ValueError(f"fare field {fare_field!r} is not a column")
    return df.withColumn("standardized_fare", C.as_number(F.col(fare_field)))


def enrich(valid: DataFrame, config: IndexConfig) -> DataFrame:
    """Route, month, horizon and comparable fare; keeps one horizon bucket if the config asks for it."""
    out = add_standardized_fare(add_booking_horizon(add_period(add_route(valid))), config.fare_field)
    if config.booking_horizon_filter:
        out = out.filter(F.col("booking_horizon_bucket") == config.booking_horizon_filter)
    return out
