"""A sample of registered queries against their SQL twins, and plan rules for all of them."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import check_queries
from fareloom import catalog, session
from fareloom.sources import domain_views

SF = "/root/testdata/sf0.001"
SAMPLE = ("national_index", "contribution_sums", "batch_report", "potential_duplicates", "traffic_diagnostics",
          "backtest_metrics", "news_context", "cpi_summary", "stream_freshness", "traffic_weights_fallback", "ingest_guard",
          "overlapping_weights", "context_signals", "cleaning_report", "official_series_file")


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, name):
    ok, note = check_queries.compare(
        spark, check_queries.connect(SF), name, contract.queries()[name], contract.oracle_sql()[name], SF
    )
    assert ok, note


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_every_query_of_the_catalog_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


class FakeSession:
    """Settings of a session whose cluster names no shared folder."""

    def __init__(self, master, warehouse):
        self.settings = {"spark.sql.warehouse.dir": warehouse}
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value

    def getConf(self):
        return self


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="all machines share"):
        session.shared_dir(FakeSession("yarn", "file:/home/me/spark-warehouse"))
    with pytest.raises(RuntimeError, match="all machines share"):
        session.shared_dir(FakeSession("local-cluster[2,1,1024]", "/home/me/spark-warehouse"))
    assert session.shared_dir(FakeSession("yarn", "s3a://lake/warehouse/")) == "s3a://lake/warehouse/_staged"
    assert session.shared_dir(FakeSession("local[4]", "file:/tmp/w")) == "file:/tmp/w/_staged"


def test_no_document_is_dropped_for_its_headline(spark, tmp_path):
    texts = [". starts with a stop. Then more.", "...", " . . x", "no stop", "First. Second.", ""]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["headline"] for r in domain_views.articles(spark, str(tmp_path)).collect()}
    assert got == {0: " starts with a stop", 1: "...", 2: " x", 3: "no stop", 4: "First", 5: ""}


def test_plan_of_the_flagship(spark):
    plan = contract.entry(spark)._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert forbidden not in plan
