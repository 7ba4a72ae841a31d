"""Registered queries and their SQL twins, grouped by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collection, forecasting, index, news, quality, streams, traffic

Query = Callable[[SparkSession, str], DataFrame]

AREAS = (index, quality, traffic, forecasting, news, collection, streams)


def queries() -> dict[str, Query]:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
