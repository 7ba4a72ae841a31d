"""URL filter, preference formatting, nearest neighbours and the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from fareloom.llm import SQL, ann, language, minhash, packing, preferences, secrets, urls
from fareloom.llm.byte_ids import ByteIds
from pyspark.sql import functions as F
from test_documents import naive_components

SMALL = "/root/testdata/sf0.001"


def twin(name: str):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con.execute(SQL[name])


@pytest.mark.parametrize("name, query", [("op7_urls", urls.op7_urls), ("op8_preferences", preferences.op8_preferences)])
def test_twins(spark, name, query):
    got, want = query(spark, SMALL), twin(name)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got.select(*names).collect()) == key(want.fetchall())
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian"))


# urls


def naive_judge(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(k, h, p) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        kind, h, p = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, h + p, kind
    query = rest[len(path) :].split("#")[0][1:]
    query = "&".join(q for q in query.split("&") if not ((q.startswith("utm_") or q.startswith("ref=")) and "=" in q))
    name = host.removeprefix("www.") + path.rstrip("/") + (f"?{query}" if query else "")
    return host, path, None, "block" if host and name in listed else "allow"


def test_urls(spark):
    cases = [None, "", "no scheme", "://", "http://", "http:///p", "http://A.NET", "http://A.NET/", "x://www.Example.net/en/1", "x://example.net/en", "x://aexample.com/de/", "x://q.example.com/de/x?y#z",
             "x://b.org/fr/", "x://org/fr/?a://b", "http://u@c.org:80/a/#f?g", "http://c.org?x=1", "http://www.c.org/a//", "http://c.org/a?utm_source=f", "http://c.org/a?ref=1&b=2", "http://É.org/É", "a\nb://c.org/a\nb", "ref://d.org/"]
    rng = random.Random(6)
    cases += [f"http://{rng.choice(['www.', 'm.', ''])}h{rng.randrange(400)}.com/{rng.choice(['a', 'b/', ''])}" for _ in range(600)]
    listed = {"c.org/a", "d.org", "c.org?x=1", *(f"h{i}.com/a" for i in range(0, 400, 3))}
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(cases)] + [(None, "http://h0.com/a", "h", "r", 1)] * 2, "page_id long, url string, host string, rule string, block int")
    got = urls.judge(pages, spark.createDataFrame([(u,) for u in listed] + [(None,)], "u string")).collect()
    assert len(got) == len(cases) + 2 and [r.verdict for r in got if r.page_id is None] == ["block"] * 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == naive_judge(cases[r.page_id], listed), cases[r.page_id]
    empty = spark.createDataFrame([], "u string")
    assert {r.verdict for r in urls.judge(pages.where("url like '%h0.com%'"), empty).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), empty).count() == 0


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS listed_url")
    filled, blocks = urls.bloom_blocks(keys, 4000)
    probe = spark.range(8000).selectExpr("id", "concat('k', id) AS key")
    probe = probe.withColumn("block", urls.block_of(probe.key, blocks)).join(filled, "block", "left")
    hit = None
    for w in range(urls.WORDS):
        bit = probe[f"word{w}"].bitwiseAND(urls.bit_of(probe.key, w)) != 0
        hit = bit if hit is None else hit & bit
    hits = {r.id for r in probe.where(hit).select("id").collect()}
    assert set(range(4000)) <= hits and len(hits) < 4080


# preferences


def naive_preferences(turns):
    found, pairs = [], {}
    for pair, rejected, turn, role, text in turns:
        if pair is not None and rejected is not None:
            turn = preferences.LAST if turn is None else turn
            pairs.setdefault(pair, ({}, {}))[rejected].setdefault(turn, set()).add((role or "", text or ""))
    for pair, (chosen, rejected) in pairs.items():
        split = min((t for t in {*chosen, *rejected} if chosen.get(t) != rejected.get(t)), default=None)
        for part, side in (("prompt", chosen), ("chosen", chosen), ("rejected", rejected)):
            for t, rows in side.items():
                for role, text in rows:
                    common = split is None or t < split
                    both = (role, text) in chosen.get(t, ()) and (role, text) in rejected.get(t, ())
                    if (part == "prompt") == (common and both):
                        head = f"<|im_start|>{role}\n"
                        shown = head + text + "<|im_end|>\n"
                        mask = (len(head), len(shown)) if part != "prompt" and role == "assistant" else (0, 0)
                        found.append((pair, part, None if t == preferences.LAST else t, role, shown, *mask))
    return found


def test_preferences(spark):
    rng = random.Random(9)
    turns = [(rng.randrange(30), rng.random() < 0.5, rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é"])) for _ in range(400)]
    turns += [(100, side, t, "user" if t % 2 == 0 else "assistant", f"same {t}" if t < 7 else f"own {side}{t}") for t in range(12) for side in (True, False)] * 2
    turns += [(None, True, 0, "user", "x"), (101, None, 0, "user", "x"), (102, False, 0, "assistant", "alone"), (103, True, 0, "user", "q"), (103, False, 0, "user", "q"), (104, True, 0, "user", "y" * 10**6)]
    frame = spark.createDataFrame([(*t, "c") for t in turns], "pair_id long, rejected boolean, turn long, role string, text string, part string")
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in preferences.format_preferences(frame).collect()) == key(naive_preferences(turns))
    assert preferences.format_preferences(frame.limit(0)).count() == 0


# nearest neighbours


def brute(vectors: dict, queries, k: int = 5):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        scores = (x * x[ids == q][0]).sum(1) / norms / norms[ids == q]
        order = [i for i in np.lexsort((ids, -scores.round(12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), scores[i]) for i in order]
    return out


@pytest.mark.parametrize("one_list", [4096, 100])
def test_neighbours(spark, monkeypatch, one_list):
    monkeypatch.setattr(ann, "ONE_LIST", one_list)
    path = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 50 == 0])
    rows = ann.op9_neighbours(spark, path).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= (1.0 if one_list > 500 else 0.7) * 5 * len(want)
    for q, found in got.items():
        for i, s in found:
            a, b = np.array(vectors[q], float), np.array(vectors[i], float)
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_scan_with_repeated_ids_and_radius():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.standard_normal((300, 40)), np.repeat(draw.standard_normal((1, 40)), 50, axis=0)])
    ids = np.concatenate([np.repeat(np.arange(100), 3), np.full(30, 7), np.arange(200, 220)])
    asked, query_ids = x[[0, 299, 310, 349]], np.array([0, 99, 7, 1000])
    scores = (asked @ x.T) / np.sqrt((x * x).sum(1)) / np.sqrt((asked * asked).sum(1))[:, None]
    for least in (-2.0, 0.4):
        got = list(zip(*(c.tolist() for c in ann.scan(asked, query_ids, np.full(4, least), x, ids, ann.rotation(40), 5))))
        want = []
        for q, row in zip(query_ids.tolist(), scores):
            best = {}
            for v, s in zip(ids.tolist(), row):
                if v != q and s >= least:
                    best[v] = max(best.get(v, -2), s)
            want += [(q, v, s) for v, s in sorted(best.items(), key=lambda t: (-round(t[1], 12), t[0]))[:5]]
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)


def test_neighbours_of_odd_tables(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(1, 9)] + [(0, [2.0, 4.0, 6.0]), (0, [2.0, 4.0, 6.0]), (20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, None, 2.0]), (23, [float("nan"), 1.0, 1.0]), (24, [float("inf"), 1.0, 1.0]), (25, []), (26, [1.0]), (None, same), (50, [-1e300, 1e300, 1e300])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = ann.nearest(frame, frame.where("vec_id in (0, 20, 21, 22, 23, 24, 25, 50)")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0] == [(0, i, i) for i in range(1, 6)]
    assert [r.vec_id for r in got if r.query_id == 50] == [0, 1, 2, 3, 4] and {r.query_id for r in got} == {0, 50}
    assert ann.nearest(frame.limit(0), frame).count() == 0
    few = frame.where("vec_id in (1, 2)")
    assert [r.vec_id for r in ann.nearest(few, few).orderBy("query_id").collect()] == [2, 1]


# pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    schema, text = docs.schema, {r.doc_id: r.text for r in docs.collect()}
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 !", None, None, None), (-3, "中文字符" * 9, None, "s", 36)], schema)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs.unionByName(odd), SMALL)
    assert first.schema == schema and {r.doc_id for r in first.collect()} == set(text)
    second = stages["near_dedup"](spark, first, SMALL)
    want = naive_components(list(text.items()), 5, 80)
    kept = {r.doc_id: r for r in second.collect()}
    assert second.schema == schema and kept.keys() == {i for i, (_, least) in want.items() if i == least}
    third = stages["secrets"](spark, second, SMALL)
    masked = {r.doc_id: r.text for r in third.collect()}
    assert third.schema == schema and masked == {i: secrets.masked(text[i]) for i in kept}
    assert all(r.n_chars == len(r.text) for r in third.collect())
    own = ByteIds(packing.VOCABULARY)
    pieces = {}
    for r in sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r.start):
        pieces[r.doc_id] = pieces.get(r.doc_id, b"") + bytes(r.ids)
    assert pieces == {i: own(t) + b"\1\0\0\0" for i, t in masked.items()}
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), SMALL).count() == 0, name
    assert language.MIN_SCORE < 0.5 and minhash.PERMUTATIONS * 2 >= 120


def test_first_stage_without_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).withColumn("lang", F.lit(None).cast("string"))
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12 !", None, "s", 4), (-3, "中文字符", None, "s", 4)], docs.schema)
    kept = corpus_pipeline.known_language(spark, docs.unionByName(odd), SMALL)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted([-3, *(r.doc_id for r in docs.collect())])


def test_first_stage_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    more = docs.withColumns({"score": F.col("doc_id") + 7, "Lang_Pred": F.lit("own"), "score_": F.lit(True)})
    kept = corpus_pipeline.known_language(spark, more, SMALL)
    assert kept.columns == more.columns and kept.count() == corpus_pipeline.known_language(spark, docs, SMALL).count() > 0
    assert all(r.score == r.doc_id + 7 and r.Lang_Pred == "own" and r.score_ is True for r in kept.collect())
