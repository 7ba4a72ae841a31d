"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "fareloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


#: Bytes of a Java method that the JIT compiler takes: a longer one of generated code would be interpreted, row by row.
JIT_BYTES = 8000


def tune(spark: SparkSession) -> SparkSession:
    """Set what results depend on (UTC), split generated code where it is too long to be compiled, leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; where none is named, one in the session's warehouse.

    A warehouse on the driver's own disk serves a local master only: executors of a cluster would not see its files.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        own = "://" not in warehouse or warehouse.startswith("file:")
        master = spark.sparkContext.master
        if own and master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all machines share: {warehouse} is on one")
        named = f"{warehouse}/_staged"
        spark.conf.set(CHECKPOINT_DIR, named)
    return named


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    For tables that several branches of one plan read (value counts, graded rows): the raw
    input is scanned once, a lost executor only costs re-reading the written files, and the
    planner sees the real size before it picks a join strategy. Zstandard, as files are read a few times only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
