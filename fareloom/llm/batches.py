"""Python functions over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Most rows and bytes of one batch; a single longer row is a batch of its own.
ROWS, BYTES = 512, "8m"


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with batches that keep executors' memory outside the heap small, for this session from now on."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    return df.mapInArrow(function, schema)
