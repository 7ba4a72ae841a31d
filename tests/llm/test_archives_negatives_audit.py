"""Archives, hard negatives and the filter audit against plain versions, on odd rows and empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fareloom.llm import filter_audit, negatives, warc

# --- Archives ---------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def read_back(archives):
    rows = warc.payloads(warc.reassemble(warc.read_records(archives))).collect()
    return sorted((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.damage) for r in rows)


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        revisit = len(payload) >= least and first is not None and (page_id is None or page_id < first)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id is not None, page_id or 0, len(payload), digest, "revisit" if revisit else "response", first if revisit else None, None))
    return sorted(out)


ODD_PAGES = [
    (1, "http://a.example/x", "same"), (2, None, "same"), (3, "", "same"), (3, "again", "same"), (3, "again", "same"), (4, "u\r\nWARC-Type: x", None),
    (5, "é ü", ""), (-7, "minus", "only here"), (None, "null id", "same"), (None, "null id", "unshared"), (8, "long", "é" * 3000 + "x\r\n\r\nWARC/1.1\r\n" * 50),
    (9, "zero", "0\r\n\r\n"), (10, "zero", "0\r\n\r\n"),
]


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("segment, archive", [(1 << 20, 1 << 20), (97, 1000)])
def test_pages_come_back(spark, least, segment, archive):
    pages = pages_of(spark, ODD_PAGES).withColumn("same", F.lit(1)).withColumn("payload", F.lit("x")).repartition(3)
    archives = warc.stage(warc.write_archives(pages, least, segment, archive), "archives-test")
    assert read_back(archives) == expected(ODD_PAGES, least)
    if segment < 100:
        assert archives.count() > 3 and archives.where("length(content) > 3000").count() == 0


def test_no_pages(spark):
    assert read_back(warc.write_archives(pages_of(spark, []))) == []
    assert read_back(spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"no archive"),)], "content binary")) == []


def record(kind, name, block, **fields):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    """Plain archives, pieces in any order and in different archives, and each kind of damage."""
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = head + b"3;ext=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nX-Trailer: 1\r\n\r\n"

    def pieces(name, numbers, total):
        out = [record("response", name, body[:20], WARC_Segment_Number=1)]
        for n in numbers:
            last = {"WARC_Segment_Total_Length": total} if n == 3 else {}
            part = body[20:50] if n == 2 else body[50:]
            out.append(record("continuation", f"{name}-{n}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=n, **last))
        return out

    whole = pieces("urn:page:1:X", [2, 3], len(body))
    files = [
        whole[2] + record("warcinfo", "info", b"software: x"),
        whole[1],
        whole[0],
        b"".join(pieces("urn:page:2:X", [3], len(body))),
        b"".join(pieces("urn:page:3:X", [2, 2, 3], len(body))),
        b"".join(pieces("urn:page:4:X", [2, 3], len(body) + 1)),
        record("response", "urn:page:5:X", head + b"5\r\nabc"),
        record("response", "urn:page:6:X", head + b"0\r\n\r\n", WARC_Payload_Digest="sha1:" + "A" * 32),
        record("response", "urn:page:7:X", b"HTTP/1.0 200 OK\r\n\r\nplain body"),
        record("response", "urn:page:8:X", b"HTTP/1.0 200 OK\r\n\r\ncut off")[:-9],
        record("continuation", "lost", b"x", WARC_Segment_Origin_ID="<urn:page:9:X>", WARC_Segment_Number=2),
    ]
    packed = warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:10:X>")], b"HTTP/1.0 200 OK\r\n\r\nzip")
    files += [packed + b"\0\0" + packed[:-20], b"\x1f\x8b" + b"broken"]
    rows = spark.createDataFrame([(bytearray(f),) for f in files], "content binary")
    found = warc.payloads(warc.reassemble(warc.read_records(rows))).collect()
    got = {r.page_id: (r.payload_bytes, r.damage) for r in found if r.page_id != 10}
    assert got == {1: (13, None), 2: (0, "segments"), 3: (None, "segments"), 4: (13, "segments"), 5: (None, "framing"), 6: (0, "digest"),
                   7: (10, None), 8: (2, "length")}
    assert (3, None) in [(r.payload_bytes, r.damage) for r in found if r.page_id == 10]


# --- Hard negatives -----------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, count=10, low=30, high=90):
    rows = [(i, label, v) for i, label, v in rows if None not in (i, label) and v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, _, v in rows]
    width = max(sorted(set(lengths)), key=lengths.count, default=0)
    rows = [(i, label, [int(x) for x in v]) for i, label, v in rows if len(v) == width]
    out = []
    for anchor in sorted({i for i, _, _ in rows if anchors(i)}):
        _, label, v = min(r for r in rows if r[0] == anchor)
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != anchor)
        for s, positive, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(anchor, positive, n, i, -s, -t) for n, (t, i, _) in enumerate(fits[:count], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("grp", F.lit("x")).withColumn("ids", F.lit(0))
    return sorted(tuple(r) for r in negatives.mine(df, anchors, **options).collect())


@pytest.mark.parametrize("width", [1, 5, 24])
def test_negatives_against_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "PACK", 7)
    rng = random.Random(width)
    rows = []
    for i in range(300):
        centre = rng.choice([0, 3, -4])  # a third of all rows have label 0, many rows are equal
        rows.append((i, rng.choice([0, 0, 1, 2, 3]), [float(rng.randint(-3, 3) + centre) for _ in range(width)]))
    rows += [(7, 1, rows[7][2]), (7, 1, rows[7][2]), (20, 3, rows[0][2]), (400, None, rows[0][2]), (None, 1, rows[0][2]), (402, 1, None)]
    rows += [(403, 1, [None] * width), (404, 1, [math.inf] * width), (405, 1, [math.nan] * width), (410, 1, []), (420, 1, [1.0] * (width + 1))]
    rows += [(430, 9, [1.0] * width), (440, 1, [0.0] * width)]
    found = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert found == plain_negatives(rows, lambda i: i % 10 == 0) and len(found) > 100


def test_negatives_of_huge_components(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(rng.randint(1, 9) * 2**26 + rng.randint(0, 5)) for _ in range(6)]) for i in range(40)]
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == plain_negatives(rows, lambda i: i % 10 == 0)
    rows = [(i, i % 2, [1e300 * (i + 1), 1.0]) for i in range(4)]
    assert {r[4] for r in mined(spark, rows, F.col("vec_id") == 0)} <= {negatives.LONG}


def test_negatives_of_nothing(spark):
    assert mined(spark, [], F.col("vec_id") % 10 == 0) == []
    assert mined(spark, [(1, 1, [1.0])], F.col("vec_id") % 10 == 0) == []


def test_packs_of_all_groups_are_not_broadcast(spark):
    columns = [F.lit(b"x").alias(c) for c in ("ids", "labels", "vectors", "summary", "extra")] + [F.lit(1).cast("long").alias("n")]
    packs = spark.range(3).select(*columns)
    blocks = negatives.dealt(spark.range(20000, numPartitions=8).select(*columns), 64)
    per_group = [r["count"] for r in blocks.groupBy("grp").count().collect()]
    assert len(per_group) == 64 and max(per_group) < 2 * min(per_group)
    found = negatives.meetings(blocks, packs, 64, 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in found and "SortMergeJoin" in found


def test_groups_hold_a_bounded_number_of_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 10), ("PACK", 7), ("GROUPS", 2), ("GROUP_BLOCKS", 8)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 1, 2]), [float(rng.randint(-3, 5)) for _ in range(5)]) for i in range(300)]
    groups, meetings = [], negatives.meetings
    monkeypatch.setattr(negatives, "meetings", lambda b, p, n, *rest: groups.append(n) or meetings(b, p, n, *rest))
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert groups == [4, 4]


def test_floors(spark):
    df = spark.createDataFrame([([0.1, -0.1, 0.5, -1 / 512, 0.0, None],)], "v array<float>")
    assert df.select(negatives.scaled(F.col("v"))).collect()[0][0] == [25.0, -26.0, 128.0, -1.0, 0.0, None]


# --- Filter audit ---------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    rows = []
    for doc_id, lang, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        repeat = any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, _, t in docs)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text), repeat]
        good, toxic = (any(i is not None and i == doc_id and r[n] == 1 for i, *r in labels) for n in (0, 1))
        rows.append((lang or "", "".join(c for c, t in zip("ABCDE", tests) if t), good, toxic))
    out = []
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                left = [r for r in own if not set(r[1]) & set(order[: step - 1])]
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(removed)
                out.append([part, order, step, len(left) - len(removed), len(removed), redundant, sum(r[1] == f for r in own),
                            sum(r[2] for r in removed), sum(r[3] for r in removed)])
    total = {}
    for r in out:
        key = r[0], r[1][r[2] - 1]
        total[key] = total.get(key, 0) + r[4]
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def odd_documents():
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randint(0, n)}" for _ in range(n))
    long = [text(n) for n in (201, 250, 300)]
    docs = [(i, rng.choice(["en", "de", None]), rng.choice([*long, "short", "LOUD WORDS", "a | b", "", None, "same " * 250, text(220)])) for i in range(80)]
    docs += [(100, "en", long[0]), (100, "en", long[0]), (100, "de", "other"), (None, "en", long[0]), (None, "en", "lonely"), (-5, "en", "short"), (101, "", "short")]
    docs += [(102, "en", "a\x1cb c\x0bd\x0c" * 120), (103, "fr", "É" * 5000)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (100, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("bits", [64, filter_audit.MOST_BITS])
def test_audit_against_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(filter_audit, "SEGMENT_KEYS", 9)
    monkeypatch.setattr(filter_audit, "LEAST_BITS", 64)
    docs, labels = odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({"part": F.lit(1), "failed": F.lit("A"), "n": F.lit(0), "key": F.lit(0)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("first", F.lit(False))
    found = filter_audit.audit(df.repartition(5), marks, bits)
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    docs = spark.createDataFrame([(None, None, None)], docs.schema)
    assert filter_audit.audit(docs, labels).where("removed = 1 and step = 1 and substring(filter_order, 1, 1) = 'A'").count() == 24


def test_sketches_clear_unique_texts(spark):
    """Every repeated key is kept, and nearly every unique one cleared, however the rows are dealt."""
    keys = spark.range(20000).selectExpr("xxhash64(if(id % 100 = 0, id % 1000, id)) AS key")
    kept = filter_audit.possible_repeats(filter_audit.sketches(keys.repartition(7), 3))
    twice = keys.groupBy("key").count().where("count > 1").select("key")
    assert twice.join(kept, "key", "left_anti").count() == 0
    assert kept.count() < twice.count() + 600
