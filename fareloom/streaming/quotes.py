"""Quotes that keep arriving: the batch rules on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IndexConfig, QualityConfig
from ..operators import cleaning, facts
from ..operators.quality import field_reason, prepare, row_flags
from ..operators.quantiles import value_counts
from ..operators.validation import enrich, with_rejection_reason
from ..session import stage
from ..sources import schemas


def stream_runs(spark: SparkSession, path: str, schema: T.StructType = schemas.OBSERVATION, form: str = "json") -> DataFrame:
    """New run files as they land."""
    return spark.readStream.schema(schema).format(form).load(path)


def checked(stream: DataFrame, fare_field: str = "total_fare") -> DataFrame:
    """The record rules of the index on a stream; stateless."""
    return with_rejection_reason(stream, fare_field)


def graded(stream: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Field reasons and row flags of the quality layer; age is measured against now."""
    rows = prepare(stream).withColumn("rejection_reason", field_reason(config))
    return row_flags(rows, config, F.current_timestamp())


def dedup_stream(stream: DataFrame, event_time: str = "scraped_at", delay: str = "2 days") -> DataFrame:
    """First arrival per observation id within the watermark. The batch rule still runs downstream."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["observation_id"])


def freshness_by_source(
    stream: DataFrame, event_time: str, delay: str = "2 days", width: str = "1 day", ok: str = "true"
) -> DataFrame:
    """Newest and oldest event, rows and good rows per source and window; late rows are dropped."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width).alias("w"), "source")
        .agg(
            F.max(event_time).alias("newest"),
            F.min(event_time).alias("oldest"),
            F.count(F.lit(1)).alias("received"),
            F.count_if(F.expr(ok)).alias("valid"),
        )
        .select(F.col("w.start").alias("window_start"), "source", "newest", "oldest", "received", "valid")
    )


IDS = "observation_id string, route string, month_ord int, standardized_fare double, bucket int, batch long"
DELTAS = "route string, standardized_fare double, n long, month_ord int, batch long"
BUCKETS = 64


def _written(df: DataFrame, path: str, *partitions: str) -> None:
    """Overwrite the partitions that `df` holds, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _within(spark: SparkSession, path: str, schema: str, column: str, values: list[int]) -> DataFrame:
    """Rows of the named partitions; other folders are not even listed."""
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{column}={v}" for v in values])


def _distinct(df: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in df.select(column).distinct().collect())


def refresh_touched_months(config: IndexConfig, store: str, facts_path: str, buckets: int = BUCKETS):
    """`foreachBatch` function that keeps route-month facts current.

    The store has two tables. `ids` holds the validated quotes of every batch by a hash bucket of their id: a batch is
    written to its buckets first and then reads these buckets alone to drop ids of earlier batches. `counts` holds what a
    batch adds, (route, fare, n) by month. Medians cannot be updated in place, so the facts of the months a batch
    touches are computed from the summed counts of these months, and those partitions are overwritten.

    What a batch reads is bounded by its buckets and months: at most `buckets` folders of ids and one folder of counts per
    touched month. The lists of both are the only values the driver sees. All writes carry the batch's number and replace
    what an earlier attempt wrote, and a replay looks at earlier batches only, so it ends in the same state.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ids_path, counts_path = f"{store}/ids", f"{store}/counts"
        good = with_rejection_reason(batch, config.fare_field).filter(F.col("rejection_reason").isNull())
        rows = enrich(good.drop("rejection_reason"), config)
        slim = rows.select("observation_id", "route", "month_ord", "standardized_fare")
        first = stage(cleaning.first_per_key(slim, ["observation_id"], ("standardized_fare",)), "batch-quotes")
        number = F.lit(batch_id).cast("long")
        bucket = F.pmod(F.xxhash64("observation_id"), F.lit(buckets)).cast("int")
        own = first.withColumns({"bucket": bucket, "batch": number})
        touched = _distinct(own, "bucket")
        if not touched:
            return
        _written(own.repartition("bucket"), ids_path, "bucket", "batch")
        seen = _within(spark, ids_path, IDS, "bucket", touched).filter(F.col("batch") < batch_id)
        fresh = own.join(seen.select("observation_id"), "observation_id", "left_anti")
        keys = ("route", "month_ord")
        delta = stage(cleaning.fare_counts(fresh, keys).drop("bin").withColumn("batch", number), "batch-counts")
        months = _distinct(delta, "month_ord")
        if not months:
            return
        _written(delta.repartition("month_ord"), counts_path, "month_ord", "batch")
        deltas = _within(spark, counts_path, DELTAS, "month_ord", months).filter(F.col("batch") <= batch_id)
        counts = value_counts(deltas, keys, "standardized_fare", "n")
        _written(facts.route_period_fares(cleaning.survivors(counts, keys, config), config), facts_path, "month_ord")

    return apply
