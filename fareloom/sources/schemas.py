"""Schemas of landed data."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


OBSERVATION = _struct(
    observation_id=S, airline=S, origin=S, destination=S, flight_date=S, booking_date=S, total_fare=D, currency=S,
    timestamp=S, source=S, fare_class=S, fare_type=S, base_fare=D, taxes=D, fees=D, stops=I, duration=D, baggage=S,
    availability=B, source_url=S, scraped_at=S, run_id=S, is_mock=B,
)

ATTEMPT = _struct(
    source=S, routes_requested=L, routes_successful=L, routes_failed=L, routes_attempted=T.ArrayType(S)
)

SOURCE_SUMMARY = _struct(
    source=S, routes_requested=L, routes_successful=L, routes_failed=L, routes_attempted=T.ArrayType(S),
    observations_collected=L, failure_breakdown=T.MapType(S, L),
)

RUN_METADATA = _struct(
    run_id=S, mode=S, started_at=S, finished_at=S, routes_requested=L, routes_successful=L, routes_failed=L,
    observations_collected=L, source_summaries=T.ArrayType(SOURCE_SUMMARY), failure_reasons=T.MapType(S, L),
)

ENVELOPE = T.StructType(
    [
        T.StructField("schema_version", S),
        T.StructField("collection_metadata", RUN_METADATA),
        T.StructField("route_attempts", T.ArrayType(ATTEMPT)),
        T.StructField("observations", T.ArrayType(OBSERVATION)),
    ]
)

TRAFFIC = _struct(Year=S, Month=S, City1=S, City2=S, PaxToCity2=S, PaxFromCity2=S)

OFFICIAL_SERIES = _struct(
    year=I, month=S, index=D, inflation=D, imputation=S, base_year=I, item=S, state=S, sector=S
)

ROUTE = _struct(
    origin_city=S, destination_city=S, origin_iata=S, destination_iata=S, priority=I, tier=I, national_weight=D,
    currently_covered=B,
)

ROUTE_FILE = T.StructType(
    [T.StructField("source", S), T.StructField("weight_period", S), T.StructField("routes", T.ArrayType(ROUTE))]
)
