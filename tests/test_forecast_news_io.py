from __future__ import annotations

import math
import random

import pytest
from conftest import month_quotes, quote_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom import IndexConfig, MatchingConfig
from fareloom.operators import benchmark, collection, forecast, news, traffic
from fareloom.sources import landed, payloads
from fareloom.streaming import quotes as streaming


def monthly(spark, values, start=24001):
    rows = [(start + i, float(v) if v is not None else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "month_ord int, value double")
    return df.withColumn("period", forecast.C.period_text(F.col("month_ord")))


def test_backtest_numbers(spark):
    row = forecast.evaluate(monthly(spark, [1, 2, 4, 8]), models=["naive"]).first()
    assert row["number_of_forecasts"] == 3
    assert row["mae"] == pytest.approx(7 / 3)
    assert row["rmse"] == pytest.approx(math.sqrt(7))
    assert row["mase"] == pytest.approx((2 + 4 / 1.5) / 2)


def test_gap_is_never_bridged(spark):
    folds = forecast.backtest(monthly(spark, [1, 2, None, 4, 5])).collect()
    got = {(r["model"], r["period"]): r["status"] for r in folds}
    assert got[("naive", "2000-03")] == "TARGET_UNAVAILABLE"
    assert got[("naive", "2000-04")] == "OK"
    assert got[("moving_average", "2000-05")] == "MODEL_NOT_APPLICABLE"


def test_the_future_does_not_leak(spark):
    def past(values):
        rows = forecast.backtest(monthly(spark, values)).filter(F.col("period") <= "2000-05").collect()
        return sorted((r["model"], r["period"], r["forecast"]) for r in rows if r["forecast"] is not None)

    assert past([1, 2, 3, 5, 8, 13, 21]) == past([1, 2, 3, 5, 8, 900, -7])


def test_forecast_after_trailing_gap(spark):
    got = {r["model"]: r for r in forecast.forecast_next(monthly(spark, [1, 2, 4, 8, None])).collect()}
    assert got["naive"]["forecast_value"] == 8.0 and got["naive"]["forecast_period"] == "2000-05"
    assert got["moving_average"]["status"] == "MODEL_NOT_APPLICABLE"
    with pytest.raises(ValueError):
        forecast.forecast_next(monthly(spark, [1]), horizon=2)


def test_custom_model_equals_built_in(spark):
    table = monthly(spark, [3, 1, None, 4, 1, 5]).withColumn("key", F.lit("k"))
    mine = forecast.backtest_custom(table, ["key"], lambda h: None if h.dropna().empty else float(h.dropna().iloc[-1]), "mine")
    ours = forecast.backtest(table, ["key"], ["naive"])
    pick = lambda df: sorted((r["month_ord"], r["forecast"] or 0.0, r["status"]) for r in df.collect())
    assert pick(mine) == pick(ours)


def test_benchmark_constant_series_has_no_correlation(spark):
    ours = monthly(spark, [100] * 8).select("month_ord", "value")
    official = monthly(spark, range(1, 9)).select("month_ord", F.col("value").alias("index"), F.lit(False).alias("imputed"))
    row = benchmark.summary(benchmark.compare(ours, official)).first()
    assert row["mom_correlation"] is None and row["mom_correlation_status"] == "INSUFFICIENT_DATA"
    assert benchmark.summary(benchmark.compare(ours.limit(0), official)).first()["status"] == "INSUFFICIENT_OVERLAP"


def test_traffic_weights(spark):
    rows = [("2026", "6", "DELHI", "MUMBAI", "600", "300"), ("2026", "6", " delhi ", "PUNE", "100", "0"),
            ("2026", "6", "Delhi", "Mumbai", "700", "1"), ("2026", "6", "X", "X", "1", "1"), ("2026", "13", "A", "B", "1", "1")]
    df = spark.createDataFrame(rows, "Year string, Month string, City1 string, City2 string, PaxToCity2 string, PaxFromCity2 string")
    valid = traffic.validate_traffic(df)
    assert valid.count() == 2
    reasons = {r["reason"]: r["n"] for r in traffic.rejection_counts(df).collect()}
    assert reasons == {"SAME_ORIGIN_DESTINATION": 1, "INVALID_MONTH": 1, "DUPLICATE_TRAFFIC_RECORD": 1}
    directed = traffic.to_directional(valid, "T")
    last = traffic.latest_month(directed)
    shares = traffic.national_weights(traffic.aggregate(directed, last - 11, last))
    got = {(r["origin"], r["destination"]): r["national_weight"] for r in shares.collect()}
    assert got[("MUMBAI", "DELHI")] == pytest.approx(0.3) and got[("DELHI", "PUNE")] == pytest.approx(0.1)
    with pytest.raises(Exception, match="no verified mapping"):
        traffic.to_city_pairs(spark.createDataFrame([("DEL", "QQQ")], "origin string, destination string"), traffic.city_map(spark)).collect()


def _articles(spark):
    rows = [
        ("n1", "2026-01-30", "https://x/1", "STRIKE", ["X"], [], []),
        ("n2", "2026-01-30", "https://x/2", "STRIKE", [], [], []),
        ("hit", "2026-01-25", "https://x/3", "OTHER", [], ["del", "BOM"], []),
        ("rev", "2026-01-31", "https://x/4", "STRIKE", [], [], ["BOM-DEL"]),
        ("else", "2026-01-31", "https://x/5", "STRIKE", ["X"], ["MAA"], []),
        ("late", "2026-03-01", "https://x/6", "STRIKE", ["X"], ["DEL"], []),
        ("dup", "2026-01-31", "https://x/4", "STRIKE", ["X"], ["DEL", "BOM"], ["DEL-BOM"]),
    ]
    df = spark.createDataFrame(rows, "headline string, day string, url string, event_type string, related_airlines array<string>, related_airports array<string>, related_routes array<string>")
    return df.withColumn("published_at", F.to_timestamp("day")).withColumn("source", F.lit("s"))


def test_ranked_articles_equal_all_pairs(spark):
    moves = spark.createDataFrame(
        [("DEL-BOM", "DEL", "BOM"), ("BLR-CCU", "BLR", "CCU")], "route string, origin string, destination string"
    ).withColumns({"change_pct": F.lit(9.0), "direction": F.lit("increase"), "metric": F.lit("mom"), "period": F.lit("2026-01"),
                   "as_of": F.to_timestamp(F.lit("2026-01-31"))})
    config = MatchingConfig(top_n=3, min_relevance=0.2)
    got = news.rank_articles(moves, _articles(spark), config)
    listed = sorted((r["route"], r["rank"], r["url"], r["relevance_score"]) for r in got.collect())
    near = news.first_by_url(news.in_window(moves, news.with_article_columns(_articles(spark)), 10))
    pairs = news.score(moves.join(near, "as_of"), config).filter("relevance_score >= 0.2").collect()
    brute = []
    for route in ("BLR-CCU", "DEL-BOM"):
        mine = sorted((r for r in pairs if r["route"] == route), key=lambda r: (-r["relevance_score"], -r["published_at"].timestamp(), r["url"]))
        brute += [(route, i + 1, r["url"], r["relevance_score"]) for i, r in enumerate(mine[:3])]
    assert listed == sorted(brute)
    assert "route" in next(r for r in got.collect() if r["route"] == "DEL-BOM" and r["url"].endswith("4"))["matched_signals"]


@pytest.mark.parametrize("top_n", [1, 3])
def test_ranked_articles_with_known_and_null_rosters(spark, top_n):
    rows = [("DEL-BOM", "DEL", "BOM", None), ("BLR-CCU", "BLR", "CCU", ["x"]), ("GOI-PNQ", "GOI", "PNQ", ["Y"])]
    moves = spark.createDataFrame(
        rows, "route string, origin string, destination string, airlines_on_route array<string>"
    ).withColumns({"change_pct": F.lit(9.0), "direction": F.lit("increase"), "metric": F.lit("mom"), "period": F.lit("2026-01"),
                   "as_of": F.to_timestamp(F.lit("2026-01-31"))})
    config = MatchingConfig(top_n=top_n, min_relevance=0.1)
    got = news.rank_articles(moves, _articles(spark), config).collect()
    near = news.first_by_url(news.in_window(moves, news.with_article_columns(_articles(spark)), 10))
    pairs = news.score(moves.join(near, "as_of"), config).filter("relevance_score >= 0.1").collect()
    brute = []
    for route in [r[0] for r in rows]:
        mine = sorted((r for r in pairs if r["route"] == route), key=lambda r: (-r["relevance_score"], -r["published_at"].timestamp(), r["url"]))
        brute += [(route, i + 1, r["url"], r["relevance_score"]) for i, r in enumerate(mine[:top_n])]
    assert sorted((r["route"], r["rank"], r["url"], r["relevance_score"]) for r in got) == sorted(brute)


def test_equal_simple_rows_keep_ids_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(collection, "COPIES_PER_BLOCK", 2)
    rows = [("DEL-BOM", 10.0, "2026-01-01", "s")] * 5 + [("DEL-BOM", None, "2026-01-01", "s"), (None, 10.0, None, "s")]
    simple = spark.createDataFrame(rows, "route string, fare double, date string, source string")
    got = [r["observation_id"] for r in collection.map_simple_observations(simple).collect()]
    assert len(got) == len(set(got)) == 7


def test_envelopes_come_back_whole(spark, tmp_path):
    report = spark.sql("""SELECT 'r1' AS run_id, 'batch' AS mode, array(named_struct('source', 's', 'routes_requested', 2L,
        'routes_successful', 1L, 'routes_failed', 1L, 'routes_attempted', array('DEL-BOM', 'DEL-MAA'))) AS source_summaries""")
    rows = quote_rows(spark, [("a", "X", "DEL", "BOM", "2026-02-01", "2026-01-01", 5.0, "INR", "r1")] * 3
                      + [("b", "X", "DEL", "BOM", "2026-02-01", "2026-01-01", 5.0, "INR", "other")], "run_id string")
    landed.write_envelopes(report, rows, f"{tmp_path}/e")
    back = landed.read_envelopes(spark, f"{tmp_path}/e")
    assert [r["run_id"] for r in back["observations"].collect()] == ["r1"] * 3
    assert back["metadata"].first()["collection_metadata"]["mode"] == "batch"
    assert back["route_attempts"].first()["routes_requested"] == 2


def test_payload_statuses(spark):
    texts = ["<html>", "[1]", '{"error":"x"}', "{}", '{"best_flights":{}}', '{"best_flights":[{"price":1}]}',
             '{"best_flights":[{"flights":[{"airline":"A","departure_airport":{"time":"2026-01-02 10:00"}}],"price":12.5}],"other_flights":[{}]}']
    df = spark.createDataFrame([("DEL", "BOM", "2026-01-02", "2026-01-01", t) for t in texts], "origin string, destination string, flight_date string, booking_date string, payload string")
    got = [r["status"] for r in payloads.itinerary_statuses(df).collect()]
    assert got == ["PARSE_ERROR", "MALFORMED_RESPONSE", "SOURCE_UNAVAILABLE", "EMPTY_RESULT", "MALFORMED_RESPONSE", "PARSE_ERROR", "SUCCESS"]
    row = payloads.parse_itineraries(df).collect()
    assert [(r["observation_id"], r["stops"], r["total_fare"]) for r in row] == [("serpapi_DEL_BOM_2026-01-02_A_12.5", 0, 12.5)]


def test_runs_are_written_once(spark, tmp_path):
    df = quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [1, 2]))
    path = landed.write_run(df, str(tmp_path), "r1")
    assert landed.read_runs(spark, [path]).count() == 2
    with pytest.raises(Exception):
        landed.write_run(df, str(tmp_path), "r1")


def test_mixed_provenance_needs_leave(spark):
    rows = [(*r, i == 0) for i, r in enumerate(month_quotes("DEL-BOM", "2026-01", [1, 2]))]
    df = quote_rows(spark, rows, "is_mock boolean")
    with pytest.raises(Exception, match="1 real and 1 mock"):
        collection.guarded_ingest(df).collect()
    assert collection.guarded_ingest(df, allow_mock=True).count() == 2
    assert collection.sample_offsets() == [1, 5, 11, 22, 45, 61]


def test_stream_batches_equal_one_batch_and_replay_is_harmless(spark, tmp_path):
    first = quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [1, 2, 3]))
    second = quote_rows(spark, month_quotes("DEL-BOM", "2026-01", [9, 8], "x") + month_quotes("DEL-BOM", "2026-01", [500]))
    apply = streaming.refresh_touched_months(IndexConfig("2026-01"), str(tmp_path / "q"), str(tmp_path / "f"))
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        apply(batch, number)
    row = spark.read.parquet(str(tmp_path / "f")).first()
    assert row["observations_used"] == 5 and row["representative_fare"] == 3.0


@pytest.mark.parametrize("top_n", [1, 3])
def test_ranking_equals_all_pairs(spark, top_n):
    """Many articles that share airports, routes and carriers in every combination, with ties and near-equal dates."""
    rng = random.Random(top_n)
    places, lines = ["DEL", "BOM", "BLR", "MAA", "CCU"], ["IndiGo", "Vistara", "Akasa Air"]
    some = lambda values, most: rng.sample(values, rng.randrange(most + 1))
    rows = []
    for i in range(400):
        ends = rng.sample(places, 2)
        routes = [f"{ends[0]}-{ends[1]}"] if rng.random() < 0.3 else []
        when = f"2026-03-{rng.randrange(1, 29):02d} {rng.choice(['00:00:00', '00:00:20', '12:00:00'])}"
        tags = [t.lower() if rng.random() < 0.2 else t for t in some(places, 4)]
        rows.append((f"h{i}", when, f"http://x/{i}", rng.choice(["OTHER", "FUEL", "DEMAND", "WEATHER"]), some(lines, 2) or None, tags, routes))
    schema = "headline string, published_at string, url string, event_type string, related_airlines array<string>, related_airports array<string>, related_routes array<string>"
    articles = spark.createDataFrame(rows, schema).withColumn("published_at", F.to_timestamp("published_at"))
    moved = [
        (f"{a}-{b}", a, b, f"2026-03-{day}", rng.choice([None, [], ["Indigo "], ["Vistara", "Akasa Air"]]))
        for a in places for b in places if a != b for day in (10, 15)
    ]
    moves = spark.createDataFrame(moved, "route string, origin string, destination string, period string, airlines_on_route array<string>")
    moves = moves.withColumns({"metric": F.lit("mom"), "as_of": F.to_timestamp("period")})
    config = MatchingConfig(top_n=top_n)
    nearby = news.in_window(moves, news.with_article_columns(articles), config.date_window_days)
    every = news.score(moves.join(nearby, "as_of"), config).filter(F.col("relevance_score") >= config.min_relevance)
    best = Window.partitionBy("route", "period").orderBy(F.desc("relevance_score"), F.desc("published_at"), "url")
    every = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n)
    columns = ("route", "period", "rank", "url", "relevance_score")
    got = sorted(tuple(r) for r in news.rank_articles(moves, articles, config).select(*columns).collect())
    assert got == sorted(tuple(r) for r in every.select(*columns).collect()) and len(got) > 20 * top_n
    lists = news.top_lists(news.first_by_url(nearby), config, True).groupBy("as_of", "roster_known", "meeting").count()
    assert lists.agg(F.max("count")).first()[0] <= top_n
