"""Weights from passenger traffic: one pass over the records, reasons, and the fallback to the metro rule."""

from __future__ import annotations

import pytest

from fareloom.operators import traffic

SCHEMA = "Year long, Month long, City1 string, City2 string, PaxToCity2 double, PaxFromCity2 double"
ROWS = [
    (2025, 1, "Delhi", "Mumbai", 100.0, 50.0), (2025, 1, " DELHI", "Mumbai ", 900.0, 900.0), (2025, 2, "Mumbai", "Bengaluru", 30.0, 20.0),
    (2025, 13, "Delhi", "Mumbai", 1.0, 1.0), (2025, 13, "Delhi", "Chennai", 1.0, 1.0), (1900, 1, "Delhi", "Mumbai", 1.0, 1.0),
    (2025, 1, "Delhi", "delhi", 1.0, 1.0), (2025, 1, None, "Mumbai", 1.0, 1.0), (2025, 1, "Delhi", "Pune", -1.0, 1.0), (2025, 1, "Delhi", "Goa", None, 1.0),
]
REASONS = {
    "MISSING_CITY": 1, "SAME_ORIGIN_DESTINATION": 1, "INVALID_MONTH": 2, "INVALID_YEAR": 1, "INVALID_PASSENGER_COUNT": 2,
    "DUPLICATE_TRAFFIC_RECORD": 1,
}


def codes(spark, *pairs):
    return spark.createDataFrame([tuple(p.split("-")) for p in pairs], "origin string, destination string")


def city_names(spark, *wanted):
    return {r["code"]: r["city"] for r in traffic.city_map(spark).collect() if r["code"] in wanted}


@pytest.fixture
def records(spark):
    names = city_names(spark, "DEL", "BOM", "BLR")
    swap = {"Delhi": names["DEL"], "Mumbai": names["BOM"], "Bengaluru": names["BLR"]}
    cell = lambda x: next((x.replace(k, v) for k, v in swap.items() if isinstance(x, str) and k in x), x)
    return spark.createDataFrame([tuple(map(cell, r)) for r in ROWS], SCHEMA)


def test_reasons_and_window(spark, records):
    weights, row = traffic.build_weights(records, codes(spark, "DEL-BOM", "BOM-BLR"))
    got = row.first()
    assert got["rejection_reasons"] == REASONS == {r["reason"]: r["n"] for r in traffic.rejection_counts(records).collect()}
    assert (got["records_received"], got["records_rejected"], got["total_routes_in_window"]) == (10, 8, 4)
    assert (got["weight_period_start"], got["weight_period_end"], got["covered_routes"]) == ("2024-03", "2025-02", 2)
    assert sorted((r["origin"], r["destination"], round(r["weight"], 6)) for r in weights.collect()) == [
        ("BOM", "BLR", round(30 / 130, 6)), ("DEL", "BOM", round(100 / 130, 6))]


def test_raw_records_are_read_once(spark, records, tmp_path):
    path = str(tmp_path / "records")
    records.write.parquet(path)
    weights, row = traffic.build_weights(spark.read.parquet(path), codes(spark, "DEL-BOM"))
    for df in (weights, row):  # what is left to run reads staged tables alone
        files = df.inputFiles()
        assert not [f for f in files if path in f]
        assert path not in df._jdf.queryExecution().executedPlan().toString()


def test_tallies_of_nothing_and_of_bad_records_only(spark, records):
    assert traffic.tally(records.limit(0)).count() == 0
    _, row = traffic.build_weights(records.filter("Month = 13"), codes(spark, "DEL-BOM"), end_period="2025-02")
    got = row.first()
    assert got["rejection_reasons"] == {"INVALID_MONTH": 2} and got["covered_routes"] == 0 and got["total_routes_in_window"] == 0
    _, row = traffic.build_weights(records.limit(0), codes(spark, "DEL-BOM"))
    assert row.first()["rejection_reasons"] == {} and row.first()["records_received"] == 0


def weights_of(df):
    return sorted((r["origin"], r["destination"], round(r["weight"], 6), r["is_real"]) for r in df.collect())


def test_metro_rule_where_traffic_does_not_serve(spark, records):
    real = traffic.weights_or_metro(records, codes(spark, "DEL-BOM", "del-bom", "BOM-BLR", "DEL-MAA"))
    assert weights_of(real) == [("BOM", "BLR", round(30 / 130, 6), True), ("DEL", "BOM", round(100 / 130, 6), True)]
    unmapped = traffic.weights_or_metro(records, codes(spark, "DEL-BOM", "DEL-QQQ"))
    assert weights_of(unmapped) == [("DEL", "BOM", 3.0, False), ("DEL", "QQQ", 1.0, False)]
    uncovered = traffic.weights_or_metro(records, codes(spark, "DEL-MAA"))
    assert weights_of(uncovered) == [("DEL", "MAA", 3.0, False)]
    assert weights_of(traffic.weights_or_metro(records, codes(spark, "DEL-BOM").limit(0))) == []
    with pytest.raises(Exception, match="no verified mapping for QQQ"):
        traffic.build_weights(records, codes(spark, "DEL-QQQ"))[0].collect()
