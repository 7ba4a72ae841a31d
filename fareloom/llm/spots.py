"""Document fingerprints from spot signatures: chains of content words that follow common words.

A spot is an anchor (a very common word) directly before a content word; its signature is the hash of the next
`CHAIN` content words, other anchors skipped within `SPAN` words. The fingerprint is the sorted set of a text's
signatures. A text with words but no spot has one signature of all its words, one without any word but with
characters one of its characters, and an empty (or null) text the empty set.

Likeness is the Jaccard similarity of two fingerprints, exact for stated pairs. A search for all pairs of a likeness or
more (`similar`) puts the distinct fingerprints in partitions by size: sizes bound the likeness by smaller / larger, so a set
meets its own partition and the next. There sets meet on their rarest signatures, as many as two sets of that likeness
can't all differ in, and only where the sizes and the place of the shared signature leave it possible is it computed.

DataFrame functions only. The next document in descending order is found on ids: a range partitioning, a window in
each range and one row per range to join the ends; texts meet by equi-joins on (id, hash).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom.session import stage

CHAIN = 2
SPAN = 7
SIMILARITY = 0.8
NO_ID = -(1 << 63)

#: Very common words of the languages covered, lower case.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "der die das den dem des ein eine und ist im zu mit von auf für nicht sich "
    "le la les un une des et est en du de que qui dans pour sur au pas "
    "el los las una y es se por con del al lo como para su no"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column) -> Column:
    """Sorted array of the distinct signatures of a text that is not null."""
    anchors = sorted(set(ANCHORS))
    filled = lambda w: w.isNotNull()
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def spots(marked: Column) -> Column:  # null where an anchor stands
        def signature(word: Column, i: Column) -> Column:
            chain = F.slice(F.filter(F.slice(marked, i + 2, F.lit(SPAN)), filled), 1, CHAIN)
            return F.when(word.isNull() & F.get(marked, i + 1).isNotNull(), F.xxhash64(chain))

        return F.filter(F.transform(marked, signature), filled)

    def of_words(w: Column) -> Column:
        found = let(F.transform(w, lambda x: F.when(~x.isin(anchors), x)), spots)
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).when(text != "", F.array(F.xxhash64(text))).otherwise(F.array().cast("array<long>"))
        return let(found, lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(whole))

    return let(words, of_words)


def written(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), " ")


def size_class(n: Column, least: float = SIMILARITY) -> Column:
    """Number of the class of a set's size: sets of likeness `least` or more are at most one class apart."""
    width = max(-math.log(least), 1e-9) * (1 + 1e-9)
    return F.floor(F.log(F.greatest(n, F.lit(1))) / width).cast("long")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    exact = let(common, lambda c: c / (F.size(a) + F.size(b) - c))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).otherwise(exact)


def similar(prints: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class_id) and links (a, b, likeness) of classes a < b of all texts of a likeness of `least` or more.

    `prints` has doc_id and sigs (sorted distinct signatures). Rows of one fingerprint are one class, named by its least
    doc_id, so copies are never paired. Rows without doc_id and empty fingerprints take no part. Every class sends its rarest
    signatures, a share of 1 - least of its set, so a signature in a third of all texts is sent by few; a signature that many
    classes do send is one key, which AQE splits.
    """
    rows = prints.where("doc_id is not null and size(sigs) > 0")
    classes = stage(rows.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "spots-classes")
    members = rows.join(classes, "sigs").select("doc_id", "class_id")
    counts = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    each = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(counts, "sig")
    ordered = each.groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "sig"))).alias("rare"))
    sent = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    ordered = stage(ordered.select("class_id", "n", F.slice(F.transform("rare", lambda x: x["sig"]), F.lit(1), sent).alias("rare")), "spots-rare")
    spread = ordered.select("class_id", "n", size_class(F.col("n"), least).alias("part"), F.posexplode("rare").alias("at", "sig"))
    left = spread.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    right = spread.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "sig", "part")
    met = left.join(right, ["part", "sig"]).where("part > own or a < b")
    # what can still be shared from the signature on decides if the likeness can be reached
    most = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    possible = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9) & (most >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9)
    pairs = met.where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("class_id", "sigs")
    with_a = pairs.join(sets.toDF("a", "sigs_a"), "a")
    both = with_a.join(sets.toDF("b", "sigs_b"), "b").withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b")))
    return members, both.where(F.col("likeness") >= least).select("a", "b", "likeness")


def next_ids(rows: DataFrame) -> DataFrame:
    """place, mark, n_chars and the place and mark of the following row, in descending order, of distinct rows.

    After the last row comes the first.
    """
    order = [F.desc("place"), F.desc("mark")]
    ids = rows.select("place", "mark", "n_chars").distinct().repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    here = Window.partitionBy("range").orderBy(*order)
    own = F.struct("place", "mark")
    # the ranges are drawn anew by each run of this plan, so it runs once, into a table
    linked = stage(ids.select("*", F.lead(own).over(here).alias("next"), F.first(own).over(here).alias("head")), "spots-next")
    ends = linked.where("next is null")  # one row per range
    ranges = Window.orderBy("range")
    first = F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.withColumn("next", F.coalesce(F.lead("head").over(ranges), first))
    whole = linked.where("next is not null").unionByName(ends)
    return whole.select("place", "mark", "n_chars", F.col("next.place").alias("next_place"), F.col("next.mark").alias("next_mark"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each row of `docs` (doc_id, text), of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    row in descending doc_id; after the last comes the first. Rows of one doc_id are ordered by a hash of the text,
    rows equal in both are one place in the order, and a null doc_id comes last.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("place"), F.xxhash64(text).alias("mark"), text.alias("text"))
    links = next_ids(rows.select("place", "mark", F.length("text").cast("long").alias("n_chars")))
    third = F.floor(F.col("n_chars") / 3).cast("int")

    after = links.select(F.col("place").alias("p"), F.col("mark").alias("m"), third.alias("third"), F.col("next_place").alias("place"), F.col("next_mark").alias("mark"))
    lent = rows.join(after, ["place", "mark"]).select(
        F.col("p").alias("place"), F.col("m").alias("mark"), F.struct(F.expr("substring(text, 1, third)").alias("head"), signatures(F.col("text")).alias("sigs")).alias("lent")
    )
    lent = lent.groupBy("place", "mark").agg(F.first("lent").alias("lent"))  # rows equal in both gave the same
    both = rows.join(lent, ["place", "mark"]).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), "lent.head"))
    marked = both.select(
        F.when(F.col("place") != NO_ID, F.col("place")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("own"),
        signatures(F.col("edited")).alias("changed"),
        F.col("lent.sigs").alias("following"),
    )
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        size_class(F.size("own")).alias("size_partition"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
