"""Streaming jobs run to the end of the landed data, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import columns as C
from ..session import shared_dir, stage, tune
from ..sources import domain_views as V
from ..streaming import quotes as ST
from . import views as S
from .quality import DIRTY

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream, spark, name: str):
    """Run an append query over everything landed so far and return what it wrote."""
    out = folder(spark, name)
    (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(out)


def land(df, spark, name: str):
    """Write a table as landed files and open them as a stream."""
    path = folder(spark, name)
    df.write.parquet(path)
    return ST.stream_runs(spark, path, df.schema, "parquet")


def land_in_parts(df, path: str, key: str = "observation_id") -> int:
    """Write landed files dealt by a key, as many as the size of the table asks for; the number of files that make two batches."""
    df.repartition(key).write.parquet(path)
    files = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    return max(1, -(-2 * files // 3))


@query(
    "stream_checked",
    f"WITH src AS ({S.fares_dirty()}), checked AS ({S.CHECKED}) SELECT coalesce(rejection_reason, 'VALID') AS reason, count(*) AS n FROM checked GROUP BY 1",
)
def _checked(spark, sf):
    stream = ST.checked(land(V.fares_dirty(spark, sf), spark, "landed"))
    rows = drain(stream.select("observation_id", "rejection_reason"), spark, "checked")
    return rows.groupBy(F.coalesce("rejection_reason", F.lit("VALID")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_graded",
    DIRTY + "SELECT coalesce(field_reason, 'OK') AS reason, count(*) AS n FROM fields GROUP BY 1",
)
def _graded(spark, sf):
    stream = ST.graded(land(V.fares_dirty(spark, sf), spark, "landed"))
    rows = drain(stream.select("observation_id", "rejection_reason"), spark, "graded")
    return rows.groupBy(F.coalesce("rejection_reason", F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


DELAY_DAYS = 10
_RESENT = "o_orderkey % 5 = 0 AND year(o_orderdate) <= 1997"


@query(
    "stream_dedup",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS observation_id, CAST(1 + CASE WHEN {_RESENT} THEN 1 ELSE 0 END AS BIGINT) AS passed FROM orders",
)
def _dedup(spark, sf):
    """One arrival a year. A repeat within the delay is dropped, one that comes too late is dropped as late, and one of
    three years on, whose first arrival is out of the state by then, passes."""
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("observation_id"), F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
        F.year("o_orderdate").alias("arrival"), F.expr(_RESENT).alias("resent"),
    )
    again = rows.filter("pmod(xxhash64(observation_id), 3) = 0").withColumn("scraped_at", F.col("scraped_at") + F.expr("INTERVAL 2 DAY"))
    late = rows.filter("pmod(xxhash64(observation_id), 7) = 0 AND arrival <= 1998").withColumn("arrival", F.col("arrival") + 2)
    resent = rows.filter("resent").withColumns(
        {"scraped_at": F.add_months("scraped_at", 36).cast("timestamp"), "arrival": F.col("arrival") + 3}
    )
    sent = stage(rows.unionByName(again).unionByName(late).unionByName(resent).drop("resent"), "arrivals")
    landed = folder(spark, "landed")
    years = sorted(r[0] for r in sent.select("arrival").distinct().collect())
    for year in years:  # files are taken up in the order they land
        sent.filter(F.col("arrival") == year).drop("arrival").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(sent.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(landed)
    passed = drain(ST.dedup_stream(stream, delay=f"{DELAY_DAYS} days"), spark, "dedup")
    return passed.groupBy("observation_id").agg(F.count(F.lit(1)).alias("passed"))


@query(
    "stream_freshness",
    f"""WITH c AS ({S.CALLS}) SELECT source, strftime(date_trunc('day', called_at), '%Y-%m-%d') AS day, count(*) AS received, count(*) FILTER (WHERE status = 'SUCCESS') AS valid,
    strftime(max(called_at), '%Y-%m-%d %H:%M:%S') AS newest FROM c GROUP BY 1, 2, date_trunc('day', called_at) HAVING date_trunc('day', called_at) + INTERVAL 1 DAY <= (SELECT max(called_at) FROM c) - INTERVAL 2 DAY""",
)
def _freshness(spark, sf):
    """Windows the watermark has closed; the open ones of the last two days are not out yet."""
    calls = V.calls(spark, sf).select("source", "status", "called_at")
    stream = ST.freshness_by_source(land(calls, spark, "landed"), "called_at", ok="status = 'SUCCESS'")
    rows = drain(stream, spark, "freshness")
    return rows.select(
        "source", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "received", "valid",
        F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"),
    )


@query(
    "stream_refreshed_months",
    S.index_ctes() + f"SELECT route, {S.period('month_ord')} AS period, {S.r('fare', 4)} AS representative_fare, n AS observations_used FROM facts",
)
def _refreshed(spark, sf):
    """Facts kept current batch by batch equal the facts of one batch over everything."""
    landed, quotes_path, facts_path = (folder(spark, n) for n in ("landed", "quotes", "facts"))
    fares = V.fares(spark, sf)
    share = land_in_parts(fares, landed)
    stream = spark.readStream.schema(fares.schema).option("maxFilesPerTrigger", share).parquet(landed)
    (
        stream.writeStream.foreachBatch(ST.refresh_touched_months(IndexConfig(S.BASE), quotes_path, facts_path))
        .option("checkpointLocation", f"{landed}-state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    rows = spark.read.parquet(facts_path)
    return rows.select(
        "route", C.period_text(F.col("month_ord")).alias("period"), F.round("representative_fare", 4).alias("representative_fare"),
        "observations_used",
    )
