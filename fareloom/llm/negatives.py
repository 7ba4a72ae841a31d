"""Hard negatives: rows of another label whose inner product with an anchor lies in a range below each positive's.

Vectors are integers. They are stored in blocks of at most `BLOCK` rows, with every vector's mean and deviation over
1, 4 and 16 segments (`LEVELS`) beside them. The inner product of two vectors is the sum over segments of length *
mean * mean, plus or minus at most the product of the deviations (norms about the mean), so the summaries bound it
from both sides. Anchors come in packs of at most `PACK`; each pack meets each block once for the positives and once
for the negatives. A meeting goes through the levels from coarse to fine: a pair is dropped when its upper bound is under the
range, its lower bound above it, or its upper bound under the k-th best lower bound of pairs that are sure to be in
the range. What is left is scored exactly. A meeting gives at most k rows per anchor and range, which Spark ranks.

Blocks and packs meet in an equi-join on a block group: no label and no vector is a key, so a label or a vector that a third
of all rows have is spread like any other. Packs go along to every group, so there are `GROUPS` of them, or fewer for few blocks,
or more where a group would have over `GROUP_BLOCKS`: up to that, what is shuffled grows like the rows. Work is anchors times rows.

A row whose id, label or vector is null, or whose vector is empty or holds a null or non-finite component, takes no
part; nor do vectors of other than the most frequent length. A row with the anchor's own id is neither its positive nor
its negative. Rows that repeat an id are candidates of their own, as anchor they count once (least label, then least
vector). Equal scores go by the smaller id. Scores beyond 64 bits are compared exactly and returned as the nearest
long. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom.session import stage

from .batches import map_batches

BLOCK = 4096
PACK = 256
#: Groups that blocks are dealt to, and blocks of a group that a task may have to hold.
GROUPS, GROUP_BLOCKS = 256, 64
LEVELS = (1, 4, 16)
#: Rows that a task sorts by label and mean before it cuts blocks, in bytes of doubles.
HELD_BYTES = 64 << 20
#: Pairs scored at once where few of a meeting are left.
PAIRS = 1 << 14
#: Share of the product of norms by which bounds are widened: more than rounding to single precision can move them.
SLACK = 1e-5
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, as doubles: integers without a bound of size."""
    return F.transform(vector.cast("array<double>"), lambda x: F.rint(x * factor) - F.when(F.rint(x * factor) > x * factor, 1.0).otherwise(0.0))


# --- One meeting of a pack and a block ----------------------------------------------------------


def summaries(x):
    """Single-precision means (times root of the length) and deviations of all levels, one column per segment."""
    import numpy as np

    columns = []
    for cuts in LEVELS:
        parts = np.array_split(x, min(cuts, x.shape[1]), axis=1)
        means = [p.mean(axis=1) for p in parts]
        columns += [m * p.shape[1] ** 0.5 for m, p in zip(means, parts)]
        columns += [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for m, p in zip(means, parts)]
    return np.stack(columns, axis=1).astype(np.float32)


def levels_of(width: int) -> list[tuple[slice, slice]]:
    """Columns of the means and of the deviations of each level."""
    found, at = [], 0
    for cuts in (min(c, width) for c in LEVELS):
        found.append((slice(at, at + cuts), slice(at + cuts, at + 2 * cuts)))
        at += 2 * cuts
    return found


def products(q, x, i=None, j=None):
    """Exact inner products of all rows, or of the pairs (i, j): doubles where they are exact, else Python integers."""
    import numpy as np

    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1]
    if not most < 2.0**53:
        q, x = (np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, x))
    if i is None:
        return q @ x.T
    parts = [slice(at, at + PAIRS) for at in range(0, len(i), PAIRS)]
    return np.concatenate([(q[i[p]] * x[j[p]]).sum(axis=1) for p in parts]) if parts else np.empty(0)


def meet(q, q_summary, x, x_summary, ids, alive, low, high, k: int):
    """(anchor index, row index, score) of the k best pairs of each anchor and range, a pair in several ranges once.

    `alive` marks the pairs that may be looked at; `low` and `high` are ranges of longs, one row per anchor.
    """
    import numpy as np

    # the ranges as doubles, rounded outwards for what may lie inside and inwards for what surely does
    under, over_low = (np.nextafter(low.astype(np.float64), d) for d in (-np.inf, np.inf))
    under_high, over = (np.nextafter(high.astype(np.float64), d) for d in (-np.inf, np.inf))

    norms = [np.sqrt((s[:, :2].astype(np.float64) ** 2).sum(axis=1)) for s in (q_summary, x_summary)]
    slack = SLACK * np.outer(*norms)
    for means, deviations in levels_of(x.shape[1]):
        if not alive.any():
            break
        middle = (q_summary[:, means] @ x_summary[:, means].T).astype(np.float64)
        reach = q_summary[:, deviations] @ x_summary[:, deviations].T + slack
        lower, upper = middle - reach, middle + reach
        needed = np.zeros_like(alive)
        for c in range(low.shape[1]):
            near = alive & (upper >= under[:, c, None]) & (lower <= over[:, c, None])
            if near.shape[1] > k:
                sure = np.where(near & (lower > over_low[:, c, None]) & (upper < under_high[:, c, None]), lower, -np.inf)
                least = np.partition(sure, -k, axis=1)[:, -k]
                near &= upper >= least[:, None]
            needed |= near
        alive = needed
    i, j = np.nonzero(alive)
    dense = len(i) * 8 > alive.size
    scores = products(q, x)[i, j] if dense else products(q, x, i, j)
    order = np.lexsort((ids[j], -scores, i))
    i, j, scores = i[order], j[order], scores[order]
    taken = np.zeros(len(i), bool)
    for c in range(low.shape[1]):
        inside = np.flatnonzero((scores >= low[i, c]) & (scores <= high[i, c]))
        of = i[inside]
        taken[inside[np.arange(len(of)) - np.searchsorted(of, of) < k]] = True
    return i[taken], j[taken], scores[taken]


# --- Tables of blocks and packs -------------------------------------------------------------------


def packer(most: int, width: int):
    """Arrow function: rows (vec_id, label, embedding, extra doubles ...) to rows of at most `most` vectors each.

    What a task holds at a time is sorted by label and mean, so that summaries of a block are alike.
    """
    import numpy as np
    import pyarrow as pa

    names = ["ids", "labels", "vectors", "summary", "extra", "n"]

    def matrix(column):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def rows(ids, labels, x, extra):
        order = np.lexsort((x.mean(axis=1), labels))
        for part in (order[at : at + most] for at in range(0, len(order), most)):
            v = x[part]
            small = np.abs(v).max() < 1 << 15
            raw = (v.astype(np.int16) if small else v).tobytes()
            yield ids[part].tobytes(), labels[part].tobytes(), raw, summaries(v).tobytes(), extra[part].tobytes(), len(part)

    def batch(found):
        kinds = [pa.binary()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)], names)

    def function(batches: Iterator):
        held, count = [], 0
        for b in batches:
            if b.num_rows:
                extra = matrix(b.column(3)) if b.num_columns > 3 else np.empty((b.num_rows, 0))
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)), extra))
                count += b.num_rows
            if count * width * 8 >= HELD_BYTES:
                yield batch(list(rows(*(np.concatenate(c) for c in zip(*held)))))
                held, count = [], 0
        if held:
            yield batch(list(rows(*(np.concatenate(c) for c in zip(*held)))))

    return function


def dealt(blocks: DataFrame, groups: int) -> DataFrame:
    """The blocks with their group: those of a task in turn, from a start of its own."""
    place = F.monotonically_increasing_id()
    start = F.pmod(F.xxhash64(F.shiftright(place, 33)), F.lit(groups))
    return blocks.withColumn("grp", F.pmod(start + place.bitwiseAND((1 << 33) - 1), F.lit(groups)).cast("int"))


PACKED = "ids binary, labels binary, vectors binary, summary binary, extra binary, n long"


def meetings(blocks: DataFrame, packs: DataFrame, groups: int, width: int, k: int, shares: tuple[int, int] | None = None) -> DataFrame:
    """(anchor_id, vec_id, score) of every pack with every block: the k best of the anchor's label.

    With `shares` (hundredths), the k best of other labels in the range around each of the anchor's positive scores,
    which are the packs' extra columns, cut into halves that doubles hold.
    """
    import numpy as np

    def ranges_of(halves):
        count = halves.shape[1] // 2
        least, most = (np.full((len(halves), count), v, np.int64) for v in (LONG, -LONG))
        for a, c in zip(*np.nonzero(np.isfinite(halves[:, :count]))):
            score = (int(halves[a, c]) << 32) + int(halves[a, count + c])
            least[a, c], most[a, c] = -(-score * shares[0] // 100), score * shares[1] // 100
        return least, most

    def unpacked(ids, labels, vectors, summary, extra, n):
        kind = np.int16 if len(vectors) == n * width * 2 else np.float64
        x = np.frombuffer(vectors, kind).astype(np.float64).reshape(n, width)
        floats = np.frombuffer(extra, np.float64).reshape(n, -1)
        return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), x, np.frombuffer(summary, np.float32).reshape(n, -1), floats

    def search(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            for row in range(b.num_rows):  # one at a time: a row holds a block and a pack
                values = [c[row].as_py() for c in b.columns]
                ids, labels, x, x_summary, _ = unpacked(*values[:6])
                q_ids, q_labels, q, q_summary, halves = unpacked(*values[6:])
                alive = (q_labels[:, None] == labels[None]) == (shares is None)
                alive &= q_ids[:, None] != ids[None]
                low, high = ranges_of(halves) if shares else (np.full((len(q), 1), v, np.int64) for v in (-LONG, LONG))
                i, j, scores = meet(q, q_summary, x, x_summary, ids, alive, low, high, k)
                longs = [max(-LONG, min(LONG, int(s))) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(longs, pa.int64())], ["anchor_id", "vec_id", "score"])

    asked = packs.select(*[F.col(c).alias(f"q_{c}") for c in packs.columns]).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # the planner takes the packs of all groups for as small as those of one: without the hint it would broadcast them
    asked, blocks = asked.repartition(groups, "grp"), blocks.repartition(groups, "grp")
    pairs = asked.hint("merge").join(blocks, "grp").select(*packs.columns, *[c for c in asked.columns if c != "grp"])
    return map_batches(pairs, search, "anchor_id long, vec_id long, score long")


def best(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(rank, F.row_number().over(place)).where(F.col(rank) <= k)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `vectors` has vec_id (long), label (long) and embedding (integers as doubles); rows for which `anchors` holds are
    anchors. A negative's score lies between `low` and `high` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    width, parts = lengths[0]["width"], -(-lengths[0]["count"] // BLOCK)
    groups = max(min(parts, GROUPS), -(-parts // GROUP_BLOCKS))
    rows = rows.where(F.size("embedding") == width)
    blocks = map_batches(rows, packer(BLOCK, width), PACKED)
    blocks = stage(dealt(blocks, groups), "negatives-blocks")
    asked = rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")

    found = meetings(blocks, map_batches(asked, packer(PACK, width), PACKED), groups, width, positives)
    own = stage(best(found, ["anchor_id"], positives, "place"), "negatives-positives")

    halves = own.select("anchor_id", "place", F.shiftright("score", 32).alias("top"), F.col("score").bitwiseAND(0xFFFFFFFF).alias("rest"))
    at = lambda c, p: F.coalesce(F.max(F.when(F.col("place") == p, F.col(c))).cast("double"), F.lit(float("inf")))
    scores = F.array(*[at(c, p) for c in ("top", "rest") for p in range(1, positives + 1)])
    scores = halves.groupBy(F.col("anchor_id").alias("vec_id")).agg(scores.alias("halves"))
    ranged = asked.join(scores, "vec_id").select("vec_id", "label", "embedding", "halves")
    found = meetings(blocks, map_batches(ranged, packer(PACK, width), PACKED), groups, width, negatives, (low, high))
    exact = own.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = found.join(exact, "anchor_id")
    p, n = F.col("positive_score").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)")
    both = both.where((p * low <= n * 100) & (n * 100 <= p * high))
    return best(both, ["anchor_id", "place"], negatives, "rank").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of the five positives of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    divisible = lambda n: F.pmod(F.col("vec_id"), F.lit(n)) == 0
    label = F.when(divisible(7), F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("embedding")), divisible(100))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
