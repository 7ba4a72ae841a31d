"""Incremental months read what a batch touches; ids leave the state of the dedup."""

from __future__ import annotations

import glob
import os
import random

from conftest import month_quotes, quote_rows
from pyspark.sql import functions as F

from fareloom import PriceIndex
from fareloom.catalog import queries
from fareloom.config import IndexConfig
from fareloom.streaming import quotes as ST

SF = "/root/testdata/sf0.001"
MONTHS = ["2026-01", "2026-02", "2026-03"]


def facts_of(spark, path):
    rows = spark.read.parquet(path).select("route", "month_ord", "representative_fare", "observations_used").collect()
    return sorted(tuple(r) for r in rows)


def whole(spark, rows, config):
    facts = PriceIndex(quote_rows(spark, rows), config).facts
    return sorted(tuple(r) for r in facts.select("route", "month_ord", "representative_fare", "observations_used").collect())


def spoil(paths):
    """Files that fail any job that reads them."""
    for path in paths:
        for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
            with open(file, "wb") as f:
                f.write(b"not parquet")
            checksum = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
            if os.path.exists(checksum):
                os.unlink(checksum)


def test_four_batches_read_their_own_months_and_buckets(spark, tmp_path):
    config = IndexConfig("2026-01")
    rng = random.Random(1)
    batches = [[q for m in MONTHS for r in ("DEL-BOM", "BOM-DEL") for q in month_quotes(r, m, [rng.randint(3000, 9000) for _ in range(9)], str(n))] for n in range(2)]
    batches.append(month_quotes("DEL-BOM", "2026-02", [1000, 2000, 3000]))
    batches.append(batches[0][:4] + batches[2] + month_quotes("DEL-BLR", "2026-02", [4000, 4000, 90000, 4100, 4200]))  # repeats among new ids
    store, facts_path = str(tmp_path / "store"), str(tmp_path / "facts")
    apply = ST.refresh_touched_months(config, store, facts_path)
    for n, rows in enumerate(batches[:3]):
        apply(quote_rows(spark, rows), n)
    assert facts_of(spark, facts_path) == whole(spark, sum(batches[:3], []), config)

    # the fourth batch may read the months of its new quotes and the buckets of its ids, and nothing else
    ids = quote_rows(spark, batches[3]).select(F.pmod(F.xxhash64("observation_id"), F.lit(ST.BUCKETS)).alias("b")).distinct().collect()
    own = {f"bucket={r['b']}" for r in ids}
    buckets = {os.path.basename(p) for p in glob.glob(f"{store}/ids/bucket=*")}
    assert len(buckets - own) > 20
    february = quote_rows(spark, batches[2]).select(F.expr("2026 * 12 + 2")).first()[0]
    spoil([f"{store}/ids/{b}" for b in buckets - own])
    spoil([p for p in glob.glob(f"{store}/counts/month_ord=*") if not p.endswith(f"={february}")])
    for _ in range(2):  # a replay ends in the same state
        apply(quote_rows(spark, batches[3]), 3)
        assert facts_of(spark, facts_path) == whole(spark, sum(batches, []), config)


def test_batches_without_new_quotes_change_nothing(spark, tmp_path):
    config, rows = IndexConfig("2026-01"), month_quotes("DEL-BOM", "2026-01", [1000, 2000])
    apply = ST.refresh_touched_months(config, str(tmp_path / "store"), str(tmp_path / "facts"))
    apply(quote_rows(spark, [(*rows[0][:6], -1.0, "INR")]), 0)
    assert not os.path.exists(tmp_path / "facts")
    apply(quote_rows(spark, rows), 1)
    before = facts_of(spark, str(tmp_path / "facts"))
    apply(quote_rows(spark, rows), 2)
    apply(quote_rows(spark, []), 3)
    assert facts_of(spark, str(tmp_path / "facts")) == before == whole(spark, rows, config)


def test_ids_leave_the_state(spark, tmp_path):
    schema = "observation_id string, scraped_at timestamp"
    out = str(tmp_path / "out")
    arrivals = [["a 2026-01-01", "a 2026-01-02", "b 2026-01-05"], ["b 2026-01-06", "c 2026-01-20"], ["a 2026-01-02", "d 2026-02-10"], ["a 2026-03-01", "d 2026-02-11"]]
    for rows in arrivals:
        made = spark.createDataFrame([tuple(r.split()) for r in rows], "observation_id string, at string")
        made.select("observation_id", F.to_timestamp("at").alias("scraped_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = (
        ST.dedup_stream(stream, delay="7 days").writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    )
    started.awaitTermination()
    passed = sorted(f"{r.observation_id} {r.scraped_at:%Y-%m-%d}" for r in spark.read.parquet(out).collect())
    assert [p for p in passed if p[0] in "bcd"] == ["b 2026-01-05", "c 2026-01-20", "d 2026-02-10"]
    assert [p[0] for p in passed].count("a") == 2 and "a 2026-03-01" in passed
    operators = [s for p in started.recentProgress for s in p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in operators) >= 3 and operators[-1]["numRowsTotal"] < 3


def test_registered_dedup_lets_late_repeats_pass(spark):
    passed = {r["passed"]: r["count"] for r in queries()["stream_dedup"](spark, SF).groupBy("passed").count().collect()}
    assert set(passed) == {1, 2} and passed[2] < passed[1]
