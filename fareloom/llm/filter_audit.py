"""Audit of filters that overlap: what every order of five document filters keeps, removes and loses, per language.

Duplicates by a counting Bloom filter. A task sketches its texts' 64-bit hashes: a hash travels once per task, with the
count one or "two or more". The sketches of a segment of the hash space are merged into `SLOTS` counters, `PROBES` of
them per hash, and the hashes are held against the merged counters: one that finds a counter under two is the only one
of its kind, so its text is guaranteed unique. All other hashes are possible repeats. They are marked in a bitmap of at
most `MOST_BITS` bits that tasks get whole; beyond that size the bitmap gets fuller, so more unique texts
count as possible, which costs time and never a result. Only possible repeats shuffle with their text, to
find the least doc_id per full text, which combines before the shuffle.

Flags. A document's failures are a set of filter letters; per part and set there is one row of counts, and
every figure of the 120 orders is a sum over these rows: a document is removed by the first of its filters in the order.

Edges. A null text is empty; a null lang is the part ''. A null doc_id is neither smaller nor larger than another, so
its row never fails E, nor does another because of it. Rows that repeat a doc_id count as rows; of equal text, none of them
is a repeat of the other. Of several labels of one doc_id, quality or toxic counts if any row says 1. An empty table has
no part and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.session import stage

from .batches import map_batches

FILTERS = "ABCDE"
SLOTS = 1 << 17
PROBES = 4
#: Different hashes for which a segment's counters are made.
SEGMENT_KEYS = SLOTS // 16
#: Hashes that a task holds before it writes its sketch.
HELD = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
WORD = 64
BANNED = b"#$%&*|"
CAPITALS = bytes(range(65, 91))


# --- Counting Bloom filter ------------------------------------------------------------------------------


def sketches(keys: DataFrame, segments: int) -> DataFrame:
    """(segment, keys, repeated) of `keys` (one long column): each task's different hashes and whether it saw them twice."""

    def function(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        def sketch(held):
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            of = (found.view(np.uint64) % np.uint64(segments)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            found, counts, of = found[order], counts[order], of[order]
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(cuts[1:], len(of))
            rows = [(int(of[a]), found[a:z].tobytes(), (counts[a:z] > 1).astype(np.uint8).tobytes()) for a, z in zip(cuts, ends)]
            for at in range(0, len(rows), 4096):
                columns = zip(*rows[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["segment", "keys", "repeated"])

        held, count = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            count += b.num_rows
            if count >= HELD:
                yield from sketch(held)
                held, count = [], 0
        if count:
            yield from sketch(held)

    return map_batches(keys, function, "segment long, keys binary, repeated binary")


def possible_repeats(sketched: DataFrame) -> DataFrame:
    """Hashes (`key`) that the merged counters of their segment don't clear as unique."""

    def merge(table):
        import numpy as np
        import pyarrow as pa

        keys, repeated = (np.concatenate([np.frombuffer(c.as_py(), t) for c in table[n]]) for n, t in (("keys", np.int64), ("repeated", np.uint8)))
        h = keys.view(np.uint64)
        first, step = h * np.uint64(0x9E3779B97F4A7C15), (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        probe = np.arange(PROBES, dtype=np.uint64)[:, None]
        slots = ((first >> np.uint64(32)) + probe * ((step >> np.uint64(32)) | np.uint64(1))) % np.uint64(SLOTS)
        counters = np.bincount(slots.ravel().astype(np.int64), weights=np.tile(repeated + 1, PROBES), minlength=SLOTS)
        return pa.table({"key": np.unique(keys[(counters[slots] >= 2).all(axis=0)])})

    return sketched.groupBy("segment").applyInArrow(merge, "key long")


def bitmap(keys: DataFrame, most_bits: int = MOST_BITS):
    """Bits of `keys` as words of 64: sized by their count, `most_bits` at most. A bounded array, made by partial sums."""
    import numpy as np

    count = keys.count()
    bits = LEAST_BITS
    while bits < min(16 * count, most_bits):
        bits *= 2
    place = F.pmod("key", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(WORD)).cast("int"))
    words = keys.groupBy(F.floor(place / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    filled = np.zeros(bits // WORD, np.int64)
    if count:
        found = words.toArrow()
        filled[found["word"].to_numpy()] = found["bits"].to_numpy()
    return filled


def sketch_repeats(docs: DataFrame, most_bits: int = MOST_BITS):
    """The bitmap of hashes of texts that may occur more than once; `docs` has doc_id and text."""
    keys = docs.where("doc_id is not null").select(F.xxhash64("text").alias("key"))
    segments = max(1, -(-docs.count() // SEGMENT_KEYS))
    return bitmap(stage(possible_repeats(sketches(keys, segments)), "audit-possible"), most_bits)


# --- Filters ----------------------------------------------------------------------------------------------


def failures(text: str) -> str:
    """Letters of the filters A to D that a text fails. Words are cut at the six ASCII white characters."""
    raw = text.encode()
    words = raw.split()
    failed = "A" if len(words) < 200 else ""
    if 100 * len(set(words)) < 50 * len(words):
        failed += "B"
    if 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * len(text):
        failed += "C"
    return failed + "D" if len(raw.translate(None, BANNED)) < len(raw) else failed


def flagged(docs: DataFrame, seen) -> DataFrame:
    """doc_id, part, failed (letters A to D), key, and the text of possible repeats, else null."""
    held = docs.sparkSession.sparkContext.broadcast(seen)

    def function(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = held.value
        for b in batches:
            key = b.column(2).to_numpy()
            place = key % (len(words) * WORD)
            possible = (words[place // WORD] >> (place % WORD)) & 1 == 1
            possible &= np.asarray(b.column(0).is_valid())
            failed = pa.array([failures(t.as_py()) for t in b.column(3)], pa.string())
            repeats = pc.if_else(pa.array(possible), b.column(3), pa.scalar(None, b.column(3).type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), failed, b.column(2), repeats], ["doc_id", "part", "failed", "key", "repeat"])

    rows = docs.select("doc_id", "part", F.xxhash64("text").alias("key"), "text")
    return map_batches(rows, function, "doc_id long, part string, failed string, key long, repeat string")


def mask_counts(docs: DataFrame, labels: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """part, failed (letters), n, good and toxic: documents by the set of filters they fail."""
    docs = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = stage(flagged(docs, sketch_repeats(docs, most_bits)), "audit-flags")
    # the row of the least id of a text is named by id and two hashes: no text is a join key, and ids aren't hot
    other = F.xxhash64("repeat", F.lit(1))
    firsts = rows.where("repeat is not null").groupBy("repeat").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("doc_id", F.xxhash64("repeat").alias("key"), other.alias("other"), F.lit(True).alias("first"))
    narrow = rows.select("doc_id", "part", "failed", "key", other.alias("other"), F.col("repeat").isNotNull().alias("possible"))
    # rows alike in all that follows are counted first: an id that many rows repeat is one row
    narrow = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = narrow.join(firsts, ["doc_id", "key", "other"], "left").join(marks, "doc_id", "left")
    repeats = F.col("possible") & F.col("first").isNull()
    failed = F.concat("failed", F.when(repeats, "E").otherwise(""))
    n = F.col("n")
    return joined.groupBy("part", failed.alias("failed")).agg(
        F.sum(n).alias("n"),
        F.sum(n * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def orders(counts: DataFrame) -> DataFrame:
    """Figures of every order and step from the additive counts (part, failed, n, good, toxic)."""
    every = ["".join(p) for p in permutations(FILTERS)]
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(every)), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.expr("substring(filter_order, step, 1)")
    fails = F.contains(F.col("failed"), own)
    early = F.expr("failed <> translate(failed, substring(filter_order, 1, step - 1), '')")
    total = lambda test, c="n": F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    # in as many of all orders as there are filters in the set, each filter of it comes first
    share = F.when(fails, F.col("n") * F.floor(F.lit(len(every)) / F.length("failed"))).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~early).alias("kept"),
        total(fails & ~early).alias("removed"),
        total(fails & early).alias("redundant"),
        total(F.col("failed") == own).alias("unique_fails"),
        total(fails & ~early, "good").alias("good_lost"),
        total(fails & ~early, "toxic").alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """All orders of the five filters over `docs` (doc_id, lang, text), held against `labels` (doc_id, quality, toxic)."""
    return orders(mask_counts(docs, labels, most_bits))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, all orders."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
  FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, failed),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS own FROM o, range(1, 6) AS r(step)),
t AS (
  SELECT part, filter_order, step, own, failed, n, good, toxic, contains(failed, own) AS fails,
    step > 1 AND translate(failed, before, '') <> failed AS early
  FROM c, s),
g AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    coalesce(sum(n) FILTER (NOT fails AND NOT early), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT early), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND early), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT early), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT early), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM g
"""
