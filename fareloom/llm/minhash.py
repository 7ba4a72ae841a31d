"""Near-duplicates by min-max hashing: least and greatest hash of each permutation, banded, then confirmed.

A text's set holds the hashes (64 bits) of its distinct shingles. Each of `PERMUTATIONS` gives two values, its least
and its greatest, so 60 evaluations give 120. Bands of these values put texts into buckets.

1. Texts of one set are one class; only classes go on, so thousands of copies cost one.
2. In each bucket, every class is paired with the bucket's least class, and the pair confirmed on full sets: a
   bucket of n gives n - 1 pairs.
3. What these links leave apart: the classes paired with one least class, if they ended in several components, are
   compared with each other in blocks of bounded size, exactly and inside a task; only links come out. Compared are
   classes of different components, one of which at least isn't linked to the least class, unless their sizes or
   their similarities to it (1 - similarity is a metric) rule a link out. So no link between classes that share a
   bucket is lost, and no pairs are written out to be tested.
4. Components of all links by star steps.

At a similarity of s a pair shares no bucket with probability (1 - s^rows)^bands: 8e-7 at 0.85 with 24 bands of 5,
1.4e-7 at 0.8 with 30 bands of 4; more similar pairs are lost less often still.

Words are runs of other characters than space and 0x09-0x0D, A-Z lower-cased. A text with fewer words than a shingle
has its whole sequence as one; one without words (or null) has the empty set and is linked with nothing. Documents
are rows: rows equal in doc_id and text are one document; a null doc_id stands after all others, its component is
the least non-null doc_id reachable, or null.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.session import stage

from .batches import map_batches
from .components import components

PERMUTATIONS = 60
SEED = 10
#: Shingles of one text that are hashed at once.
STRIDE = 4096
#: Mean number of classes, and of characters, in a block of a group that is compared.
BLOCK, BLOCK_CHARS = 64, 1 << 20
#: Slices by which the size of a group reaches its rows.
SLICES = 64


def shingle_set(text: str | None, words: int):
    """Sorted distinct hashes of the shingles of a text."""
    import numpy as np
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # bytes: ASCII letters and white space only
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    length = min(n, words)
    s = np.full(n - length + 1, length, np.uint64)
    for i in range(length):
        s = (s ^ h[i : n - length + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def permutations(count: int):
    import numpy as np

    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, count), np.uint64)
    return (draw[0] | np.uint64(1))[:, None], draw[1][:, None]


def min_max(values, permuted):
    """Least and greatest hash of each permutation, alternating."""
    import numpy as np

    factor, shift = permuted
    low, high = None, None
    for at in range(0, len(values), STRIDE):
        h = values[at : at + STRIDE] * factor + shift
        a, b = h.min(axis=1), h.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.stack([low, high], axis=1).ravel()


def band_hashes(signature, bands: int, rows: int):
    """One hash per band of consecutive signature values; the band's number is part of it."""
    import numpy as np

    v = signature[: bands * rows].reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        h = (h ^ v[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """place, mark, doc_id, size, class (digest of the set; null if empty) and bands of every row."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        permuted = permutations(PERMUTATIONS)
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            sizes, classes, hashes = [], [], []
            for text in b.column(3).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                hashes.append(band_hashes(min_max(s, permuted), bands, rows) if len(s) else None)
            columns = [*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "mark", "size", "class", "bands"])

    return map_batches(keyed(docs), run, "doc_id long, place long, mark long, size long, class binary, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, place and mark (non-null id and hash of the text: the key of a row) and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), *row_key(doc_id, text), text.alias("text"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """`pairs` (a, b: classes) with the sizes of intersection and union of their sets; `texts`: class, text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, last_set = None, None
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            common, union = [], []
            for a, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:  # pairs of one class mostly follow each other
                    last, last_set = a, shingle_set(text_a, words)
                other = shingle_set(text_b, words)
                n = len(np.intersect1d(last_set, other, assume_unique=True))
                common.append(n)
                union.append(len(last_set) + len(other) - n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "union"])

    of = lambda side: texts.select(F.col("class").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return map_batches(both, run, "a binary, b binary, common long, union long")


def apart(near: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that `near` pairs with the same class a and `labels` has in different components."""
    label = lambda side, name: labels.select(F.col("node").alias(side), F.col("label").alias(name))
    rows = near.select("a", "b", (F.col("common") / F.col("union")).alias("near")).join(label("b", "label"), "b", "left").join(label("a", "centre"), "a", "left")
    rows = rows.select("a", "b", "near", F.coalesce("label", "b").alias("label"), F.coalesce("centre", "a").alias("centre"))
    mixed = rows.where("label <> centre").groupBy("a").count().select("a")
    rows = stage(rows.join(mixed, "a").join(texts.withColumnRenamed("class", "b"), "b").select("a", "b", "near", "label", "text"), "minhash-apart")
    # a group's size goes back to its rows by slices of the group, so that its texts never meet on one key
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("b", F.lit(1)), F.lit(SLICES)))
    slices = rows.groupBy("a", "slice").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("long")
    sizes = slices.select("a", "slice").join(slices.groupBy("a").agg(blocks.alias("blocks")), "a")
    rows = rows.join(sizes, ["a", "slice"])
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")
    packed = stage(rows.groupBy("a", block).agg(F.collect_list(F.struct("b", "near", "label", "text")).alias("rows")), "minhash-blocks")
    limit = percent / 100

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width, group = 1 - limit + 1e-9, None
        kept: dict = {}
        joined: dict = {}  # of the group at hand: components that links found in this task have joined

        def root(label):
            while label in joined:
                if joined[label] in joined:  # the way gets shorter each time
                    joined[label] = joined[joined[label]]
                label = joined[label]
            return label

        def block_sets(a, block, rows):
            if (a, block) not in kept:
                if len(kept) >= 4:
                    kept.clear()
                kept[a, block] = [shingle_set(r["text"], words) for r in rows]
            return kept[a, block]

        for batch in batches:
            links = []
            for row in range(batch.num_rows):  # one at a time: a row holds two blocks of texts
                a, i, left, j, right = (c[row].as_py() for c in batch.columns)
                if a != group:
                    group = a
                    joined.clear()
                own, others = block_sets(a, i, left), block_sets(a, j, right)
                sizes, near = np.array([len(s) for s in others]), np.array([r["near"] for r in right])
                for x, s in zip(left, own):
                    if x["near"] >= limit:
                        continue
                    fits = (np.abs(near - x["near"]) <= width) & (np.minimum(sizes, len(s)) * 100 >= np.maximum(sizes, len(s)) * percent)
                    # a pair of two classes not linked to the centre is compared once
                    asked = [k for k in np.flatnonzero(fits).tolist() if root(right[k]["label"]) != root(x["label"]) and (near[k] >= limit or x["b"] < right[k]["b"])]
                    if not asked:
                        continue
                    values = np.concatenate([others[k] for k in asked])
                    at = np.minimum(np.searchsorted(s, values), len(s) - 1)
                    starts = np.concatenate([[0], np.cumsum(sizes[asked])[:-1]])
                    common = np.add.reduceat(s[at] == values, starts, dtype=np.int64)
                    for k, n in zip(asked, common.tolist()):
                        one, other = root(x["label"]), root(right[k]["label"])
                        if n * 100 >= (len(s) + int(sizes[k]) - n) * percent and one != other:
                            joined[one] = other  # one link joins the components
                            links.append((x["b"], right[k]["b"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.binary()) for n in (0, 1)], ["a", "b"])

    # all rows of a left block travel: its sets are shared with its turn on the right
    left = packed.where(F.exists("rows", lambda r: r["near"] < limit)).select("a", F.col("block").alias("block_x"), F.col("rows").alias("rows_x"))
    both = left.join(packed, "a").select("a", "block_x", "rows_x", "block", "rows")
    return map_batches(both, run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """Signed rows of `docs` (see `signed`), and class, component_id, keep_place, keep_mark of every non-empty class.

    Links join sets of at least `percent` hundredths of similarity. component_id is the least doc_id of a component;
    the row at (keep_place, keep_mark) is the one to keep of it.
    """
    signs = stage(signed(docs, words, bands, rows), "minhash-rows")
    own = F.min(F.struct("place", "mark")).alias("first")
    classes = signs.where("class is not null").groupBy("class").agg(own, F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = stage(classes, "minhash-classes")

    banded = classes.select("class", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").count().where("count > 1").select("bucket")
    members = stage(banded.join(shared, "bucket"), "minhash-members")
    least = members.groupBy("bucket").agg(F.min("class").alias("a"))
    stars = members.withColumnRenamed("class", "b").join(least, "bucket").where("a <> b").select("a", "b").distinct()
    stars = stage(stars, "minhash-pairs")
    needed = members.select("class").distinct().join(classes.select("class", "first.place", "first.mark"), "class")
    texts = keyed(docs).join(needed, ["place", "mark"]).groupBy("class").agg(F.first("text").alias("text"))
    texts = stage(texts, "minhash-texts")

    near = stage(confirmed(stars, texts, words), "minhash-confirmed")
    linked = F.col("common") * 100 >= F.col("union") * percent
    links = near.where(linked).select("a", "b")
    labels = components(links)

    more = stage(apart(near, labels, texts, words, percent), "minhash-more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    labels = stage(labels, "minhash-labels")
    whole = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    ids = whole.groupBy("label").agg(F.min("least_id").alias("component_id"), F.min("first").alias("keep"))
    found = whole.join(ids, "label").select("class", "component_id", F.col("keep.place").alias("keep_place"), F.col("keep.mark").alias("keep_mark"))
    return signs, stage(found, "minhash-found")


def kept_rows(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each group of near-duplicates; documents with an empty set all stay."""
    signs, found = near_duplicates(docs, **how)
    whole = signs.select("place", "mark", "class").join(found, "class", "left")
    keep = whole.where("class is null or (place = keep_place and mark = keep_mark)").select("place", "mark").distinct()
    columns = docs.columns
    names = [f"_row_{i}" for i in range(len(columns))]  # clashing names of other columns stay apart
    inner = docs.toDF(*names)
    key = row_key(F.col(names[columns.index("doc_id")]).cast("long"), F.col(names[columns.index("text")]).cast("string"))
    stay = inner.select("*", *key).join(keep, ["place", "mark"]).dropDuplicates(["place", "mark"])
    return stay.select(*(F.col(n).alias(c) for n, c in zip(names, columns)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with three-word shingles at a similarity of 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    signs, found = near_duplicates(docs, words=3, percent=85, bands=24, rows=5)
    whole = signs.select("doc_id", "size", "class").join(found.select("class", "component_id"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = whole.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


near_dedup = partial(kept_rows, words=5, percent=80, bands=30, rows=4)
