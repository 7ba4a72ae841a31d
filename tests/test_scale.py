"""Plans that keep growing tables out of repeated shuffles, and files that grow in number with them."""

from __future__ import annotations

import os

import pytest
from conftest import month_quotes, quote_rows
from pyspark.sql import functions as F

from fareloom import IndexConfig, PriceIndex
from fareloom.catalog.streams import land_in_parts
from fareloom.operators import news, quality
from fareloom.session import stage
from fareloom.sources import domain_views as V
from fareloom.sources import landed


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString().split("== Initial Plan ==")[-1]


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("warehouse"))
    tables = {
        "nation": ([(0, 1), (1, 0)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(1, 0), (2, 1)], "s_suppkey long, s_nationkey int"),
        "customer": ([(1, 1), (2, None)], "c_custkey long, c_nationkey int"),
        "orders": ([(1, 1, "1996-01-02"), (2, 2, "1996-01-02"), (3, None, None)], "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": (
            [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 2), (3, 1, 2, 1), (None, 1, 1, 1), (1, 2, None, 3)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int",
        ),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
        if name == "lineitem":
            extra = {c: F.lit(10.0) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
            df = df.withColumns({**extra, "l_returnflag": F.lit("N"), "l_shipdate": F.lit("1996-02-01").cast("timestamp")})
        df.write.parquet(f"{base}/{name}.parquet")
    return base


def test_line_items_meet_orders_that_have_their_customer(spark, warehouse):
    # a customer of no nation has no region either and drops out, but a nation code that is null
    for level, ends, nowhere in (("region", ("BOM", "DEL"), 0), ("nation", ("DEL", "BOM"), 1)):
        rows = V.fares(spark, warehouse, level)
        top = next(line for line in plan(rows, "optimizedPlan").splitlines() if "Join" in line)
        assert "l_orderkey" in top and "o_orderkey" in top
        got = sorted(((r["observation_id"], r["origin"], r["destination"]) for r in rows.collect()), key=str)
        assert [r[0] for r in got[:2]] == ["1-1-1-1", "1-1-1-1"] and {r[1:] for r in got[:2]} == {ends}
        assert len(got) == 2 + nowhere and all(r[0].startswith("2-") for r in got[2:])
    top = next(line for line in plan(V.traffic(spark, warehouse), "optimizedPlan").splitlines() if "Join" in line)
    assert "l_orderkey" in top


def test_grading_reads_its_input_once_and_drops_unused_searches(spark):
    rows = quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [100, 100.5, 100, 900]) * 2, "")
    assert "ExistingRDD" not in plan(quality.grade(rows))
    judged = quality.verdicts(rows)
    again = judged.filter(F.col("rejection_reason") == "EXACT_DUPLICATE")
    assert "collect_list" in plan(judged) and "collect_list" not in plan(again)
    assert "collect_list" not in plan(judged.filter(F.col("status") != "REJECTED").select("route").distinct())
    assert judged.agg(F.sum("copies")).first()[0] == 8 and again.agg(F.sum("copies")).first()[0] == 5


def test_route_without_a_significant_movement_is_known(spark):
    every = spark.createDataFrame(
        [("DEL-BOM", "2026-01", "mom", 1.0, "increase")], "route string, period string, metric string, change_pct double, direction string"
    )
    ranked = spark.createDataFrame(
        [], "route string, period string, metric string, rank int, headline string, source string, published_at string, url string, summary string, "
        "event_type string, relevance_score double, confidence_score double, is_mock boolean",
    )
    moves = every.filter("abs(change_pct) >= 5")
    assert news.route_context(moves, ranked, "DEL-BOM", 5.0, among=every).count() == 0
    with pytest.raises(Exception, match="unknown route: 'BOM-DEL'"):
        news.route_context(moves, ranked, "BOM-DEL", 5.0, among=every).collect()


def test_observations_of_envelopes_are_not_shuffled_to_their_run(spark):
    rows = quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [100, 200]), "").withColumn("run_id", F.lit("r"))
    report = rows.groupBy("run_id").agg(F.array(F.struct(F.lit("s").alias("source"))).alias("source_summaries"))
    tables = landed.collection_envelopes(report, rows, rows.select("run_id", F.lit("s").alias("source")))
    assert "Exchange hashpartitioning" not in plan(tables["observations"])
    assert tables["observations"].count() == 2


def test_run_files_are_compressed(spark, tmp_path):
    rows = quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [100, 200]), "")
    path = landed.write_run(rows, str(tmp_path), "r")
    assert all(f.endswith(".json.gz") for f in os.listdir(path) if f.startswith("part-"))
    assert landed.read_runs(spark, [path]).agg(F.sum("total_fare")).first()[0] == 300.0


def test_landed_files_grow_in_number(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        share = land_in_parts(spark.range(1000).selectExpr("cast(id AS string) AS observation_id"), f"{tmp_path}/landed")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len([f for f in os.listdir(f"{tmp_path}/landed") if f.startswith("part-")]) == 4 and share == 3


def test_facts_are_found_once_for_all_results(spark):
    rows = quote_rows(spark, [q for m in ("01", "02") for q in month_quotes("DEL-BOM", f"2026-{m}", [100, 110, 120, 130])])
    index = PriceIndex(rows, IndexConfig("2026-01"))
    for result in (index.national(), index.inflation(), index.contributions()):
        text = plan(result)
        assert "/facts-" in text and "/fare-limits-" not in text
    assert [r["national_index"] for r in index.national().orderBy("period").collect()] == [100.0, 100.0]


def test_generated_code_stays_short_enough_to_be_compiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_little_goes_into_shuffles_and_staged_files(spark, warehouse):
    rows = V.fares(spark, warehouse)
    assert "l_tax" not in plan(rows, "optimizedPlan").splitlines()[0]
    assert {r["total_fare"] for r in rows.collect()} == {-990.0}  # 10 * (1 - 10) * (1 + 10)
    files = stage(rows, "some-rows").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    judged = quality.verdicts(quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [100, 200, 300])))
    assert {len(r["row_key"]) for r in judged.collect()} == {8}
