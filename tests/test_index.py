from __future__ import annotations

import pytest
from conftest import month_quotes, quote_rows
from pyspark.sql import functions as F

from fareloom import IndexConfig, PriceIndex
from fareloom.functions import columns as C
from fareloom.operators import cleaning, validation
from fareloom.operators.quantiles import exact_percentiles, trimmed_means, value_counts

BASE, NOW = "2026-01", "2026-03"


def spread(center):
    return [center + d for d in range(5)]


def weights(spark, rows):
    return spark.createDataFrame(rows, "origin string, destination string, weight double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_one_route_index(spark):
    rows = month_quotes("DEL-BOM", BASE, spread(5000)) + month_quotes("DEL-BOM", NOW, spread(5500))
    row = one(PriceIndex(quote_rows(spark, rows), IndexConfig(BASE)).national(NOW, NOW))
    assert row["national_index"] == pytest.approx(110, abs=0.5)
    assert row["mom_change_pct"] is None and row["yoy_change_pct"] is None
    assert row["observations_used"] == 5


def test_weighted_mean_and_contributions(spark):
    rows = (
        month_quotes("DEL-BOM", BASE, [5000] * 5) + month_quotes("DEL-BOM", NOW, [5500] * 5)
        + month_quotes("DEL-BLR", BASE, [4000] * 5) + month_quotes("DEL-BLR", NOW, [4200] * 5)
        + month_quotes("DEL-BOM", "2026-02", [5000] * 5) + month_quotes("DEL-BLR", "2026-02", [4000] * 5)
    )
    table = weights(spark, [("DEL", "BOM", 3.0), ("DEL", "BLR", 1.0)])
    index = PriceIndex(quote_rows(spark, rows), IndexConfig(BASE), table)
    row = one(index.national(NOW, NOW))
    assert row["national_index"] == pytest.approx(108.75)
    assert row["mom_change_pct"] == pytest.approx(8.75)
    points = {r["route"]: r["contribution_points"] for r in index.contributions(NOW, NOW).collect()}
    assert points == {"DEL-BOM": pytest.approx(7.5), "DEL-BLR": pytest.approx(1.25)}


def test_lag_is_by_calendar(spark):
    """February is missing, so March has no month-over-month change."""
    rows = month_quotes("DEL-BOM", BASE, [100] * 4) + month_quotes("DEL-BOM", "2026-03", [110] * 4)
    rows += month_quotes("DEL-BOM", "2025-03", [55] * 4)
    row = one(PriceIndex(quote_rows(spark, rows), IndexConfig(BASE)).national("2026-03", "2026-03"))
    assert row["mom_change_pct"] is None
    assert row["yoy_change_pct"] == pytest.approx(100.0)


def test_statuses(spark):
    rows = (
        month_quotes("DEL-BOM", BASE, [100] * 3) + month_quotes("DEL-BOM", NOW, [100] * 3)
        + month_quotes("DEL-BLR", BASE, [100] * 2)
        + month_quotes("DEL-MAA", NOW, [100] * 3)
        + month_quotes("DEL-CCU", BASE, [100] * 3)
        + month_quotes("DEL-HYD", BASE, [100] * 3) + month_quotes("DEL-HYD", NOW, [100])
        + month_quotes("DEL-PNQ", "2026-02", [100] * 3)
    )
    table = PriceIndex(quote_rows(spark, rows), IndexConfig(BASE)).routes(NOW, NOW)
    assert {r["route"]: r["status"] for r in table.collect()} == {
        "DEL-BOM": "OK", "DEL-BLR": "INSUFFICIENT_DATA", "DEL-MAA": "NEW_ROUTE", "DEL-CCU": "DISCONTINUED",
        "DEL-HYD": "INSUFFICIENT_DATA", "DEL-PNQ": "NO_BASE_DATA",
    }


def test_weighted_route_without_quotes_is_listed(spark):
    rows = month_quotes("DEL-BOM", BASE, [100] * 3)
    table = weights(spark, [("del", "bom", 1.0), ("DEL", "SXR", 1.0)])
    index = PriceIndex(quote_rows(spark, rows), IndexConfig(BASE), table)
    assert {r["route"]: r["status"] for r in index.routes(BASE, BASE).collect()} == {
        "DEL-BOM": "OK", "DEL-SXR": "NO_BASE_DATA",
    }
    assert one(index.national(BASE, BASE))["coverage_rate"] == pytest.approx(0.5)


def test_rejection_reasons_in_order(spark):
    good = ("1", "IndiGo", "DEL", "BOM", "2026-01-15", "2026-01-01", 100.0, "INR")

    def bad(**changes):
        names = ("id", "airline", "origin", "destination", "flight", "booking", "fare", "currency")
        return tuple(changes.get(n, v) for n, v in zip(names, good))

    rows = [
        good, bad(airline=" ", fare=-1.0), bad(flight="x"), bad(fare=None), bad(destination="del"),
        bad(booking="2026-02-01"), bad(destination="DEL "),
    ]
    got = validation.with_rejection_reason(quote_rows(spark, rows)).select("rejection_reason").collect()
    assert [r[0] for r in got] == [
        None, "MISSING_REQUIRED_FIELD", "INVALID_DATE", "INVALID_FARE", "SAME_ORIGIN_DESTINATION",
        "IMPOSSIBLE_BOOKING_HORIZON", None,
    ]
    with pytest.raises(ValueError):
        validation.validate(quote_rows(spark, rows).drop("currency"))


def test_duplicate_is_first_by_order_whatever_the_partitioning(spark):
    rows = [("a", "X", "DEL", "BOM", "2026-01-15", "2026-01-01", f, "INR", t) for f, t in ((9.0, "2"), (5.0, "3"), (7.0, "1"))]
    df = quote_rows(spark, rows, "scraped_at string")
    for parts in (1, 3):
        assert one(cleaning.drop_duplicates(df.repartition(parts)))["total_fare"] == 7.0


def test_outliers_need_four_rows_and_a_spread(spark):
    rows = month_quotes("DEL-BOM", BASE, [100, 101, 102, 103, 900]) + month_quotes("DEL-BLR", BASE, [100, 100, 900])
    rows += month_quotes("DEL-MAA", BASE, [100, 100, 100, 100, 900])
    for method in ("iqr", "mad"):
        index = PriceIndex(quote_rows(spark, rows), IndexConfig(BASE, outlier_method=method))
        assert [(r["route"], r["standardized_fare"]) for r in index.flagged.filter("is_outlier").collect()] == [("DEL-BOM", 900.0)]


def test_cleaning_report_accounts_for_every_row(spark):
    rows = month_quotes("DEL-BOM", BASE, [100, 101, 102, 103, 900]) * 2 + month_quotes("DEL-DEL", BASE, [1])
    report = {r["reason"]: r["n"] for r in PriceIndex(quote_rows(spark, rows), IndexConfig(BASE)).cleaning_report().collect()}
    assert report == {
        "received": 11, "valid": 4, "removed": 7, "DUPLICATE": 5, "OUTLIER_IQR": 1, "SAME_ORIGIN_DESTINATION": 1,
    }


def test_percentiles_match_numpy_on_skewed_groups(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    data = {"hot": np.round(rng.lognormal(6, 1, 3000), 2), "flat": np.repeat(50.0, 40), "one": np.array([3.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    counts = value_counts(df.repartition(5), ["k"], "v").cache()
    probs = {"p01": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99}
    for row in exact_percentiles(counts, ["k"], probs, "v", moments=True).collect():
        values = data[row["k"]]
        assert row["total"] == len(values)
        for name, q in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12)
        assert row["mean"] == pytest.approx(values.mean())
        if len(values) > 1:
            assert row["sd"] == pytest.approx(values.std(ddof=1), rel=1e-9)
    for row in trimmed_means(counts, ["k"], 0.1, "v").collect():
        values = np.sort(data[row["k"]])
        cut = int(0.1 * len(values))
        assert row["trimmed_mean"] == pytest.approx(values[cut : len(values) - cut].mean(), rel=1e-12)


def test_equal_fares_have_no_volatility(spark):
    row = one(PriceIndex(quote_rows(spark, month_quotes("DEL-BOM", BASE, [321.1] * 7)), IndexConfig(BASE)).route_volatility())
    assert row["volatility"] == 0.0 and row["classification"] == "LOW"


def test_horizon_buckets_and_periods(spark):
    days = spark.createDataFrame([(d,) for d in (-1, 0, 3, 4, 14, 15, 60, 61)], "d int")
    assert [r[0] for r in days.select(C.horizon_bucket(F.col("d"))).collect()] == [
        "unknown", "0-3", "0-3", "4-7", "8-14", "15-30", "31-60", "61+",
    ]
    assert C.shift_period("2026-01", -1) == "2025-12" and C.shift_period("2025-12", 13) == "2027-01"
    with pytest.raises(ValueError):
        C.period_ord("2026-13")


def test_config_is_checked():
    for bad in ({"outlier_method": "z"}, {"booking_horizon_filter": "9"}, {"trimmed_mean_proportion": 0.5}, {"min_observations": 0}):
        with pytest.raises(ValueError):
            IndexConfig(BASE, **bad)


def test_nothing_left_is_an_error(spark):
    index = PriceIndex(quote_rows(spark, month_quotes("DEL-DEL", BASE, [1.0])), IndexConfig(BASE))
    with pytest.raises(Exception, match="no observation survived"):
        index.require_survivors().national().collect()
    good = PriceIndex(quote_rows(spark, month_quotes("DEL-BOM", BASE, [1.0] * 5)), IndexConfig(BASE))
    assert good.require_survivors().national().count() == 1


def test_reports_read_the_quotes_once(spark, tmp_path):
    rows = month_quotes("DEL-BOM", BASE, [100.0] * 6 + [9000.0]) + month_quotes("DEL-BOM", BASE, [100.0]) + month_quotes("DEL-DEL", BASE, [1.0] * 3)
    path = str(tmp_path / "quotes")
    quote_rows(spark, rows).write.parquet(path)
    for options in ({}, {"booking_horizon_filter": "8-14"}):
        index = PriceIndex(spark.read.parquet(path), IndexConfig(BASE, **options))
        report = index.cleaning_report()
        assert path not in report._jdf.queryExecution().executedPlan().toString()  # the staged tally alone
        got = {r["reason"]: r["n"] for r in report.collect()}
        assert got["received"] == 11 and got["removed"] == 11 - got["valid"] and got["SAME_ORIGIN_DESTINATION"] == 3
        assert got["DUPLICATE"] == 1 and "LEFT_OUT" not in got
        assert path not in index.summary(BASE)._jdf.queryExecution().executedPlan().toString()
