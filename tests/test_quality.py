from __future__ import annotations

import random

from conftest import quote_rows
from pyspark.sql import functions as F

from fareloom.config import QualityConfig
from fareloom.operators import duplicates, health, quality

EXTRA = "source string"


def row(i, fare=5000.0, **changes):
    base = {
        "id": f"o{i}", "airline": "IndiGo", "origin": "DEL", "destination": "BOM", "flight": "2026-01-15",
        "booking": "2026-01-01", "fare": fare, "currency": "INR", "source": "s",
    }
    return tuple({**base, **changes}.values())


def graded(spark, rows):
    return {r["observation_id"]: r for r in quality.grade(quote_rows(spark, rows, EXTRA)).collect()}


def test_every_field_reason(spark):
    cases = {
        "a": ({"airline": " "}, "MISSING_AIRLINE"), "b": ({"origin": None}, "MISSING_ORIGIN"),
        "c": ({"destination": ""}, "MISSING_DESTINATION"), "d": ({"origin": "DELHI"}, "INVALID_AIRPORT_CODE"),
        "e": ({"destination": " del "}, "SAME_ORIGIN_DESTINATION"), "f": ({"flight": "soon"}, "INVALID_FLIGHT_DATE"),
        "g": ({"booking": "soon"}, "INVALID_BOOKING_DATE"), "h": ({"booking": "2026-02-01"}, "NEGATIVE_BOOKING_HORIZON"),
        "i": ({"currency": None}, "MISSING_CURRENCY"), "j": ({"currency": "USD"}, "NON_INR_CURRENCY"),
        "k": ({"fare": 0.0}, "NON_POSITIVE_FARE"),
    }
    got = graded(spark, [row(0, **{**changes, "id": key}) for key, (changes, _) in cases.items()] + [row(0, id=" ")])
    assert {k: got[k]["rejection_reason"] for k in cases} == {k: reason for k, (_, reason) in cases.items()}
    assert got[" "]["rejection_reason"] == "MISSING_OBSERVATION_ID"


def test_exact_duplicates_by_id_content_and_copy(spark):
    rows = [row(1, 100.0), row(1, 900.0), row(2, 300.0), row(3, 300.0), row(4, 500.0), row(4, 500.0), row(4, 500.0)]
    out = quality.grade(quote_rows(spark, rows, EXTRA))
    rejected = out.filter(F.col("rejection_reason") == "EXACT_DUPLICATE").agg(F.sum("copies")).first()[0]
    assert rejected == 4
    report = quality.batch_report(quote_rows(spark, rows, EXTRA), out).first()
    assert report["records_received"] == 7 and report["records_rejected"] == 4


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    fares = [100.0, 101.0, 99.0, 101.01, 102.0] + [round(rng.uniform(80, 2000), 2) for _ in range(250)]
    fares += [round(f * 1.01, 2) for f in fares[:60]] + [round(f / 1.01, 2) for f in fares[:60]]
    rng.shuffle(fares)
    unique = list(dict.fromkeys(fares))
    rows = [row(f"{i:04d}", f, source="ab"[i % 2]) for i, f in enumerate(unique)]
    expected = set()
    for side in (0, 1):
        seen = []
        for i, f in enumerate(unique):
            if i % 2 != side:
                continue
            if any(abs(f - s) <= 0.01 * max(abs(s), 1e-9) for s in seen):
                expected.add(f"o{i:04d}")
            seen.append(f)
    got = {k for k, r in graded(spark, rows).items() if "POTENTIAL_DUPLICATE" in r["flag_reasons"]}
    assert got == expected


def test_flags_and_status(spark):
    got = graded(spark, [row(1), row(2, 7000.0, airline="Nobody"), row(3, 9000.0, origin="ZZZ", booking="2025-01-01", source=None)])
    assert got["o1"]["status"] == "VALID"
    assert got["o2"]["flag_reasons"] == ["UNKNOWN_AIRLINE"]
    assert got["o3"]["flag_reasons"] == ["UNMAPPED_LOCATION", "MISSING_OPTIONAL_FIELD", "UNUSUAL_BOOKING_HORIZON"]


def test_suspicious_fare_uses_batch_for_thin_routes_only(spark):
    usual = [row(i, 5000.0 + i * 100) for i in range(12)]
    flat = [row(f"f{i}", 4000.0, destination="BLR", booking=f"2026-01-0{i + 1}") for i in range(5)] + [row("f9", 90000.0, destination="BLR")]
    thin = [row("t", 99999.0, destination="MAA")]
    got = graded(spark, usual + flat + thin)
    assert "SUSPICIOUS_FARE" in got["ot"]["flag_reasons"]
    assert "SUSPICIOUS_FARE" not in got["of9"]["flag_reasons"]


def test_schema_failure_scores_thirty(spark):
    df = quote_rows(spark, [row(1), row(2)], EXTRA).drop("airline")
    out = quality.grade(df)
    assert {r["rejection_reason"] for r in out.collect()} == {"INVALID_SCHEMA"}
    report = quality.batch_report(df, out).first()
    assert report["quality_score"] == 30.0 and report["quality_grade"] == "POOR"


def test_health_words(spark):
    out = quality.grade(quote_rows(spark, [row(1), row(2, -1.0), row(3, 7000.0, source="")], EXTRA))
    attempts = spark.createDataFrame([("s", 4, 0, 4, ["DEL-BOM", "DEL-BLR"])], "source string, routes_requested long, routes_successful long, routes_failed long, routes_attempted array<string>")
    got = {r["source"]: r["status"] for r in health.source_health(out, attempts, config=QualityConfig()).collect()}
    assert got == {"s": "FAILED", "UNKNOWN_SOURCE": "DEGRADED"}
    assert health.route_coverage(out, attempts).first()[0] == 0.5


def near_flags(spark, fares, tolerance):
    rows = [row(f"{i:04d}", f) for i, f in enumerate(fares)]
    config = QualityConfig(near_duplicate_tolerance=tolerance)
    out = quality.grade(quote_rows(spark, rows, EXTRA), config).filter(F.array_contains("flag_reasons", "POTENTIAL_DUPLICATE"))
    return {int(r["observation_id"][1:]) for r in out.collect()}


def near_pairs(fares, tolerance):
    return {i for i, f in enumerate(fares) if any(abs(f - s) <= tolerance * max(abs(s), 1e-9) for s in fares[:i])}


def test_near_duplicates_at_the_limit_for_other_tolerances(spark):
    rng = random.Random(8)
    for tolerance in (0.0004, 0.01, 0.3, 0.6):
        start = [rng.uniform(50, 60) for _ in range(25)] + [10.0 ** rng.randint(-13, 12) * rng.random() for _ in range(40)] + [5e-324]
        fares = [f * k for f in start for k in (1.0, 1 + tolerance, 1 - tolerance, 1 / (1 + tolerance), 1 / (1 - tolerance))]
        fares = list(dict.fromkeys(f for f in fares if f > 0))
        rng.shuffle(fares)
        assert near_flags(spark, fares, tolerance) == near_pairs(fares, tolerance)


def test_near_duplicates_need_no_sliding_frame_and_no_pairs(spark):
    rows = quote_rows(spark, [row(i, 100.0 + i) for i in range(20)], EXTRA)
    keyed = rows.selectExpr("xxhash64(source) AS group_key", "total_fare AS fare", "struct(observation_id) AS row_order")
    plan = duplicates.near_duplicates(keyed, QualityConfig())._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan and "Join" not in plan
    # by fare, and by band: what follows keeps that layout
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2


def test_grading_shuffles_raw_columns_once(spark):
    rows = quote_rows(spark, [(*row(1), "x" * 50), (*row(2), "y" * 50)], EXTRA + ", remark string")
    out = quality.grade(rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    scans = [line for line in plan.splitlines() if "remark" in line and "Exchange" in line]
    assert len(scans) <= 1
    assert "remark" not in quality.verdicts(rows).columns
    assert {r["remark"][0]: r["copies"] for r in out.collect()} == {"x": 1, "y": 1}


def test_many_blank_ids_are_rejected_without_meeting_on_a_key(spark):
    rows = [row(i, 100.0 + i, id=" " if i % 2 else "") for i in range(40)] + [row(99), row(99)]
    out = quality.verdicts(quote_rows(spark, rows, EXTRA)).groupBy("rejection_reason").agg(F.sum("copies").alias("n")).collect()
    assert {r["rejection_reason"]: r["n"] for r in out} == {"MISSING_OBSERVATION_ID": 40, "EXACT_DUPLICATE": 1, None: 1}


def test_only_candidates_that_share_an_id_are_shuffled_by_it(spark, monkeypatch):
    rng = random.Random(4)
    rows = [row(i, 100.0 + 5 * rng.randrange(40), id=rng.choice([f"o{i}", f"o{i % 30}", f" o{i % 30} "]), airline="ABC"[i % 3]) for i in range(240)]
    rows += rows[:20] + [row(i, 700.0 + i, id=" ") for i in range(5)] + [row(i, -1.0, id="o1") for i in range(5)]
    unique = [row(i, 100.0 + i) for i in range(50)]

    def judged(some):
        found = quality.verdicts(quote_rows(spark, some, EXTRA))
        return sorted(str(r) for r in found.drop("row_key").collect())

    expected = {}
    for name, some in (("shared", rows), ("unique", unique)):
        calls = []
        with monkeypatch.context() as m:
            m.setattr(duplicates, "SHARED_IDS", -1)  # all by id
            expected[name] = judged(some)
        marked = duplicates.mark_exact
        with monkeypatch.context() as m:
            m.setattr(quality, "mark_exact", lambda *a: calls.append(marked(*a)) or calls[-1])
            assert judged(some) == expected[name]
        plan = calls[0][0]._jdf.queryExecution().executedPlan().toString()
        assert not calls[0][1] and "Window" not in plan and "hashpartitioning" not in plan
    assert any("EXACT_DUPLICATE" in r for r in expected["shared"]) and not any("EXACT_DUPLICATE" in r for r in expected["unique"])
