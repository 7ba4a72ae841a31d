"""Conditions that fail a query while it runs."""

from __future__ import annotations

import pytest
from conftest import month_quotes, quote_rows
from pyspark.sql import functions as F

from fareloom import IndexConfig
from fareloom.operators import collection, constraints, forecast, indices, news, weights
from fareloom.plans.panel import booking_window_panels
from fareloom.sources import landed


def months(spark, rows):
    df = spark.createDataFrame(rows, "key string, month_ord int, value double")
    return df.withColumn("period", forecast.C.period_text(F.col("month_ord")))


GOOD = [("a", m, float(m)) for m in range(24001, 24007)] + [("b", m, 1.0) for m in range(24003, 24006)]
GAP = [r for r in GOOD if r[:2] != ("a", 24003)]
TWICE = GOOD + [("b", 24004, 2.0)]


@pytest.mark.parametrize("rows", [GAP, TWICE])
@pytest.mark.parametrize("run", [forecast.backtest, forecast.forecast_next, lambda t, k: forecast.backtest_custom(t, k, lambda h: 1.0, "m")])
def test_series_with_gaps_or_repeats_fail(spark, rows, run):
    assert run(months(spark, GOOD), ["key"]).count() > 0
    with pytest.raises(Exception, match="not calendar-complete"):
        run(months(spark, rows), ["key"]).collect()


def test_message_names_the_gap(spark):
    with pytest.raises(Exception, match="not calendar-complete: a goes from 2000-02 to 2000-04"):
        constraints.contiguous(months(spark, GAP), ["key"]).collect()


def test_a_check_is_not_pruned_away(spark):
    with pytest.raises(Exception, match="not calendar-complete"):
        forecast.backtest(months(spark, GAP), ["key"]).select(F.lit(1)).count()


def test_unknown_keys_fail(spark):
    table = months(spark, GOOD)
    assert {r["key"] for r in forecast.forecast_key(table, "key", "b").collect()} == {"b"}
    for run in (forecast.forecast_key, forecast.backtest_key):
        with pytest.raises(Exception, match="unknown key: 'c'"):
            run(table, "key", "c").collect()
    with pytest.raises(Exception, match="unknown key: 'a'"):
        constraints.known(table.limit(0), "key", "a").collect()


def test_unknown_route_has_no_context(spark):
    moves = spark.createDataFrame(
        [("DEL-BOM", "2026-01", "mom", 12.0, "increase")], "route string, period string, metric string, change_pct double, direction string"
    )
    articles = spark.createDataFrame(
        [], "route string, period string, metric string, rank int, headline string, source string, published_at string, url string, summary string, "
        "event_type string, relevance_score double, confidence_score double, is_mock boolean",
    )
    assert news.route_context(moves, articles, "DEL-BOM", 5.0).count() == 1
    with pytest.raises(Exception, match="unknown route: 'BOM-DEL'"):
        news.route_context(moves, articles, "BOM-DEL", 5.0).collect()


def test_ingest_of_mixed_or_unusable_rows_fails(spark):
    rows = [(*r, i == 0) for i, r in enumerate(month_quotes("DEL-BOM", "2026-01", [1, 2]))]
    df = quote_rows(spark, rows, "is_mock boolean")
    with pytest.raises(Exception, match="1 real and 1 mock observations are mixed"):
        collection.guarded_ingest(df).count()
    assert collection.guarded_ingest(df, allow_mock=True).count() == 2
    assert collection.guarded_ingest(df.filter("is_mock")).count() == 1
    with pytest.raises(Exception, match="no usable observation among 2, 2 dropped"):
        collection.guarded_ingest(df.withColumn("total_fare", F.lit(0.0)), allow_mock=True).collect()
    with pytest.raises(Exception, match="no usable observation among 0, 0 dropped"):
        collection.guarded_ingest(df.limit(0)).collect()


def test_booking_windows_of_mixed_rows_fail(spark):
    rows = [(*r, i == 0) for i, r in enumerate(month_quotes("DEL-BOM", "2026-01", [1, 2, 3, 4, 5]))]
    df = quote_rows(spark, rows, "is_mock boolean")
    config = IndexConfig("2026-01")
    with pytest.raises(Exception, match="4 real and 1 mock"):
        booking_window_panels(df, config, "2026-01", "2026-01").national.collect()
    assert booking_window_panels(df, config, "2026-01", "2026-01", allow_mock=True).national.count() > 0


WEIGHTS = "origin string, destination string, weight double, effective_from string, effective_to string"


def test_overlapping_weights(spark):
    rows = [
        ("del", "bom", 1.0, None, "2026-01-31"), ("DEL", "BOM", 2.0, "2026-02-01", None),  # one after the other
        ("DEL", "BLR", 1.0, "2026-01-01", "2026-12-31"), ("DEL", "BLR", 1.0, "2026-02-01", "2026-02-28"), ("DEL", "BLR", 1.0, "2026-12-31", None),
        ("DEL", "MAA", 1.0, None, None), ("DEL", "MAA", 1.0, "2026-05-01", "2026-04-01"),  # never in force
        ("DEL", "CCU", 1.0, None, None), ("DEL", "CCU", 1.0, None, None),
    ]
    table = spark.createDataFrame(rows, WEIGHTS)
    found = {(r["route"], r["effective_from"], str(r["taken_until"])) for r in weights.overlapping(table).collect()}
    assert found == {("DEL-BLR", "2026-02-01", "2026-12-31"), ("DEL-BLR", "2026-12-31", "2026-12-31"), ("DEL-CCU", None, "9999-12-31")}
    with pytest.raises(Exception, match="weights of DEL-(BLR|CCU) overlap from"):
        weights.weights_for_period(table, "2026-01").collect()
    periods = spark.createDataFrame([(24313,)], "month_ord int")
    with pytest.raises(Exception, match="overlap from"):
        weights.weights_for_periods(table, periods).collect()
    good = table.filter("destination IN ('bom', 'BOM', 'MAA')")
    assert {(r["route"], r["weight"]) for r in weights.weights_for_period(good, "2026-02").collect()} == {("DEL-BOM", 2.0), ("DEL-MAA", 1.0)}


def test_an_index_with_overlapping_weights_fails(spark):
    config = IndexConfig("2026-01")
    facts = spark.createDataFrame(
        [("DEL-BOM", 24313, 1.0, 5, True, 1.0, 0.0)],
        "route string, month_ord int, representative_fare double, observations_used long, sufficient boolean, mean double, sd double",
    )
    table = spark.createDataFrame([("DEL", "BOM", 1.0, None, None), ("DEL", "BOM", 2.0, "2020-01-01", None)], WEIGHTS)
    with pytest.raises(Exception, match="weights of DEL-BOM overlap from 2020-01-01"):
        indices.route_indices(facts, config, "2026-01", "2026-01", table).collect()


def series_file(tmp_path, name, rows, header="year,month,index,inflation,imputation,base_year"):
    path = tmp_path / name
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_official_series_of_a_file_and_its_errors(spark, tmp_path):
    rows = ["2026,February,101.5,,N,2024", "2026, January ,100.0,2.5,Y,2024"]
    good = landed.load_official_series(spark, series_file(tmp_path, "good.csv", rows))
    assert sorted((r["period"], r["index"], r["inflation"], r["imputed"]) for r in good.collect()) == [("2026-01", 100.0, 2.5, True), ("2026-02", 101.5, None, False)]
    cases = {
        "unknown month names: Foo": [*rows, "2026,Foo,1,,N,2024"],
        "1 repeated month": [*rows, "2026,January,1,,N,2024"],
        "expected one base year, found 2": [*rows, "2026,March,1,,N,2012"],
    }
    for n, (message, lines) in enumerate(cases.items()):
        broken = landed.load_official_series(spark, series_file(tmp_path, f"{n}.csv", lines))
        with pytest.raises(Exception, match=message):
            broken.select("period").collect()
    with pytest.raises(ValueError, match="lacks columns: \\['index'\\]"):  # not read from the column next to it
        landed.load_official_series(spark, series_file(tmp_path, "short.csv", ["2026,May,1,N,2024"], "year,month,inflation,imputation,base_year"))
    good.write.parquet(str(tmp_path / "again.parquet"))
    assert landed.load_official_series(spark, str(tmp_path / "again.parquet")).count() == 2
