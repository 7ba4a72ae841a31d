"""Readers and writers of landed files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..constants import MONTH_NAMES
from ..functions import columns as C
from ..operators.constraints import guarded
from ..session import stage
from . import schemas

ENVELOPE_VERSION = "1.0"


# --- Observations ------------------------------------------------------------------------------


def read_runs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All `*.jsonl` of a directory (or the given files) with the file name as run order."""
    reader = spark.read.schema(schemas.OBSERVATION)
    if isinstance(path, str):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    return reader.json(path if isinstance(path, str) else list(path)).select("*", F.col("_metadata.file_name"))


def load_json_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations inside collection envelopes; a file without them is an error."""
    documents = spark.read.option("multiLine", True).schema(schemas.ENVELOPE).json(path)
    missing = F.raise_error(F.concat(F.lit("no observations in "), F.col("_metadata.file_name")))
    listed = F.coalesce(F.col("observations"), missing.cast(schemas.ENVELOPE["observations"].dataType))
    return documents.select(F.explode(listed).alias("o")).select("o.*")


def write_run(df: DataFrame, base: str, run_id: str, stage: str = "raw") -> str:
    """One directory per run of gzipped JSON lines, raw and validated apart. An existing run is never overwritten."""
    if stage not in ("raw", "validated"):
        raise ValueError("stage must be raw or validated")
    target = f"{base.rstrip('/')}/{stage}/fares/run_id={run_id}"
    df.write.mode("errorifexists").option("compression", "gzip").json(target)
    return target


def collection_envelopes(
    report: DataFrame, observations: DataFrame, attempts: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Envelopes of runs as three tables keyed by `run_id`: metadata, route attempts, observations.

    The layout is the same for every run, whatever its size: one metadata record per run, one record
    per attempt and per observation, so no task gathers a run. Without `attempts` the summaries of
    the report stand in for them. An observation of a run without a report is left out.

    The report is staged: three tables read it, and with its size known observations aren't shuffled to their run.
    """
    report = stage(report, "run-reports")
    if attempts is None:
        listed = report.select("run_id", F.explode("source_summaries").alias("s"))
        attempts = listed.select("run_id", *[F.col("s")[f.name].alias(f.name) for f in schemas.ATTEMPT])
    kept = {"route_attempts": (attempts, schemas.ATTEMPT), "observations": (observations, schemas.OBSERVATION)}
    head = report.select(
        "run_id", F.lit(ENVELOPE_VERSION).alias("schema_version"), F.struct(*report.columns).alias("collection_metadata")
    )
    tables = {"metadata": head}
    for name, (rows, schema) in kept.items():
        fields = [f.name for f in schema if f.name in rows.columns and f.name != "run_id"]
        tables[name] = rows.select("run_id", *fields).join(report.select("run_id"), "run_id", "left_semi")
    return tables


def write_envelopes(
    report: DataFrame, observations: DataFrame, path: str, attempts: DataFrame | None = None
) -> None:
    """Gzipped JSON lines of each table of `collection_envelopes` in a folder of its own; existing ones are an error."""
    for name, rows in collection_envelopes(report, observations, attempts).items():
        rows.write.mode("errorifexists").option("compression", "gzip").json(f"{path.rstrip('/')}/{name}")


def read_envelopes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that `write_envelopes` wrote."""
    base = path.rstrip("/")

    def keyed(schema: StructType) -> StructType:
        return StructType([StructField("run_id", StringType()), *[f for f in schema if f.name != "run_id"]])

    return {
        "metadata": spark.read.json(f"{base}/metadata"),
        "route_attempts": spark.read.schema(keyed(schemas.ATTEMPT)).json(f"{base}/route_attempts"),
        "observations": spark.read.schema(keyed(schemas.OBSERVATION)).json(f"{base}/observations"),
    }


# --- Other tables ------------------------------------------------------------------------------


def read_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Monthly city pairs as text; the traffic rules parse and judge the values."""
    return spark.read.schema(schemas.TRAFFIC).csv(path, header=True)


def read_weights_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "origin string, destination string, weight double, effective_from date, effective_to date, source string"
    return spark.read.schema(schema).csv(path, header=True)


def official_series(df: DataFrame) -> DataFrame:
    """An official price series by month: month names to numbers, imputation flag, sorted by month.

    Unknown month names, repeated months or several base years fail the query, found by one aggregate over the (one row per
    month) table inside the same plan.
    """
    missing = [c for c in ("year", "month", "index", "inflation", "imputation", "base_year") if c not in df.columns]
    if missing:
        raise ValueError(f"official series lacks columns: {missing}")
    name = F.trim(F.col("month"))
    number = reduce(
        lambda chain, i: chain.when(name == MONTH_NAMES[i], i + 1), range(1, 12), F.when(name == MONTH_NAMES[0], 1)
    )
    work = df.withColumn("month_ord", F.col("year") * 12 + number)
    problems = work.agg(
        F.sort_array(F.collect_set(F.when(F.col("month_ord").isNull(), F.coalesce(name, F.lit("null"))))).alias("unknown"),
        (F.count("month_ord") - F.count_distinct("month_ord")).alias("repeated"),
        F.count_distinct("base_year").alias("bases"),
    )
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    problem = (
        F.when(F.size("unknown") > 0, text("unknown month names: ", F.array_join("unknown", ", ")))
        .when(F.col("repeated") > 0, text(F.col("repeated").cast("string"), " repeated month(s)"))
        .when(F.col("bases") != 1, text("expected one base year, found ", F.col("bases").cast("string")))
    )
    work = guarded(work, problems.select(problem.alias("problem")))
    return work.withColumns(
        {
            "period": C.period_text(F.col("month_ord")),
            "imputed": F.upper(F.trim(F.coalesce("imputation", F.lit("")))) != "N",
        }
    )


def load_official_series(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet file of the official series. A number that can't be read is null; a year like that is an unknown month."""
    if path.rstrip("/").endswith(".parquet"):
        return official_series(spark.read.parquet(path))
    raw = spark.read.csv(path, header=True)  # by name: a column that is missing must not shift the others
    kinds = {f.name: f.dataType for f in schemas.OFFICIAL_SERIES}
    return official_series(raw.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns]))


def load_routes(spark: SparkSession, path: str, tiers: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Planned routes with both airport codes, of the given tiers, by priority."""
    nested = spark.read.option("multiLine", True).schema(schemas.ROUTE_FILE).json(path)
    routes = nested.select(F.explode("routes").alias("r")).select("r.*")
    both = F.col("origin_iata").isNotNull() & F.col("destination_iata").isNotNull()
    return routes.filter(F.col("tier").isin(*tiers) & both).orderBy("priority")


def write_route_priority(priority: DataFrame, path: str) -> None:
    """CSV of the ranked routes; at most the top list, so one file."""
    priority.orderBy("priority_rank").coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_recommended_routes(recommended: DataFrame, weight_period: Column, path: str, source: str) -> None:
    """One nested JSON document with the recommended top list (bounded by its length)."""
    names = recommended.columns
    fields = [F.col("priority"), *[F.col(c) for c in names if c != "priority"]]
    routes = F.sort_array(F.collect_list(F.struct(*fields))).alias("routes")
    nested = recommended.agg(routes).select(
        F.lit(source).alias("source"), weight_period.alias("weight_period"), "routes"
    )
    nested.coalesce(1).write.mode("errorifexists").json(path)
