"""Approximate nearest neighbours: inverted lists scanned dimension block by dimension block.

Centres are fitted on the driver from a bounded sample (`SAMPLE` vectors); every row is assigned to its nearest
centre and written into blocks of at most `BLOCK` vectors of one list, so a list of any size is many rows. A query
opens with the nearest lists, until they hold `OPENING` of all vectors (and enough to fill its answer); the score of
the last of its k nearest there is the radius with which it probes the next lists, until all hold `SHARE`. Blocks and
packs of queries of one list meet in an equi-join on the list; each pair of a block and a pack is one bounded piece
of work, and beyond the opening only candidates within the radius leave it.

Inside, vectors are unit vectors turned by a fixed random rotation, cut into blocks of `COLUMNS` dimensions. After d
of D dimensions a candidate is abandoned when its partial squared distance exceeds the radius t itself or what, at
the usual deviation of a random projection, a candidate within t could have: t * d / D * (1 + EPSILON / sqrt(d))^2.
In the opening the radius comes from exact distances of the candidates nearest in the first columns. What is left is
scored exactly, in double precision on the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id or, if
lengths differ, those of other than the most frequent length. Rows that repeat an id count once per answer, with
their best score; a query's own id is never its answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom.session import stage

from .batches import map_batches

SAMPLE = 8192
BLOCK = 1024
PACK = 256
#: Bytes of vectors that a task holds before it writes blocks that are not full.
HELD_BYTES = 64 << 20
#: Pairs of vectors that are scored at once.
PAIRS = 1 << 14
OPENING, SHARE = 0.05, 0.7
#: Tables up to this size have one list.
ONE_LIST = 4096
MOST_LISTS = 1024
COLUMNS = 16
EPSILON = 2.6
SEED = 20


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x):
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(width: int):
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def centres(sample, lists: int):
    """Unit centres of a sample of unit vectors by spherical k-means."""
    import numpy as np

    lists = min(lists, len(sample))
    found = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]]
    for _ in range(12):
        nearest = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        norms = np.sqrt((sums * sums).sum(axis=1))
        found = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], found)
    return found


def vectors_of(column):
    """A matrix of doubles of an Arrow list column without nulls."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scan(queries, query_ids, least, vectors, ids, turn, k: int):
    """For each query its k nearest of a block with a score of `least` or more: query ids, ids and scores.

    A query with `least` under -1 has no radius yet and takes one from the block.
    """
    import numpy as np

    width = vectors.shape[1]
    x, q = (unit(vectors) @ turn).astype(np.float32), (unit(queries) @ turn).astype(np.float32)
    steps = [(low, min(low + COLUMNS, width)) for low in range(0, width, COLUMNS)]

    def distances(low, high):
        a, b = q[:, low:high], x[:, low:high]
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)

    alive = ids[None] != query_ids[:, None]
    partial = distances(*steps[0])
    radius = 2 - 2 * least
    distinct = np.unique(ids, return_index=True)[1]  # one row per id, or repeats would shrink the radius
    open_ones = np.flatnonzero(least < -1)
    if len(open_ones) and len(distinct) > k:
        first = np.where(alive, partial, np.inf)[np.ix_(open_ones, distinct)]
        near = distinct[np.argpartition(first, k - 1, axis=1)[:, :k]]
        exact = ((x[near] - q[open_ones, None]) ** 2).sum(axis=2)
        exact[ids[near] == query_ids[open_ones, None]] = 4  # the query's own row: no bound
        radius[open_ones] = exact.max(axis=1)
    radius = (radius + 1e-5).astype(np.float32)
    for n, (low, high) in enumerate(steps):
        if n and np.count_nonzero(alive) * 8 > alive.size:
            partial += distances(low, high)
        elif n:
            i, j = np.nonzero(alive)
            d = x[j, low:high] - q[i, low:high]
            partial[i, j] += (d * d).sum(axis=1)
        share = high / width
        bound = radius if high == width else radius * min(1.0, share * (1 + EPSILON / high**0.5) ** 2)
        alive &= partial <= bound[:, None]

    i, j = np.nonzero(alive)
    x, q = (m / np.abs(m).max(axis=1, keepdims=True) for m in (vectors, queries))
    x_norm, q_norm = (np.sqrt((m * m).sum(axis=1)) for m in (x, q))
    parts = [slice(at, at + PAIRS) for at in range(0, len(i), PAIRS)]
    products = [(x[j[part]] * q[i[part]]).sum(axis=1) for part in parts]
    scores = np.concatenate(products) / (x_norm[j] * q_norm[i]) if parts else np.empty(0)
    kept = scores >= least[i]
    i, found, scores = i[kept], ids[j[kept]], scores[kept]

    def sorted_by(*keys):
        order = np.lexsort(keys)
        return i[order], found[order], scores[order]

    i, found, scores = sorted_by(-scores, found, i)
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (found[1:] != found[:-1])  # an id counts once, with its best score
    i, found, scores = i[new], found[new], scores[new]
    i, found, scores = sorted_by(found, -scores, i)
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return query_ids[i[top]], found[top], scores[top]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest of `vectors` for each of `queries`.

    Both have vec_id and embedding.
    """
    import numpy as np

    spark = vectors.sparkSession
    shape = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors, queries = shape(vectors), shape(queries)
    lengths = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    width, total = lengths[0]["width"], lengths[0]["count"]
    vectors, queries = (df.where(F.size("embedding") == width) for df in (vectors, queries))
    lists = 1 if total <= ONE_LIST else min(MOST_LISTS, max(16, round(total**0.5 / 2)))

    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(place < 0.8 * SAMPLE / total).limit(SAMPLE) if lists > 1 else vectors.limit(1)
    rows = sample.orderBy("vec_id", "embedding").collect()
    centre = centres(unit(np.array([r.embedding for r in rows])), lists)
    turn = rotation(width)

    def blocks(batches):
        """Rows of one list each: ids and vectors of at most BLOCK, packed."""
        import pyarrow as pa

        held: dict[int, list] = {}
        count = 0

        def full(at: int, least: int):
            ids, rows = (np.concatenate(c) for c in zip(*held.pop(at)))
            for low in range(0, len(ids), BLOCK):
                if len(ids) - low < least:
                    held[at] = [(ids[low:], rows[low:])]
                    break
                yield at, ids[low : low + BLOCK].tobytes(), rows[low : low + BLOCK].tobytes(), len(ids[low : low + BLOCK])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["list", "ids", "vectors", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), vectors_of(b.column(1))
            of = (unit(x) @ centre.T).argmax(axis=1)
            out = []
            for at in np.unique(of).tolist():
                held.setdefault(at, []).append((ids[of == at], x[of == at]))
                if sum(len(i) for i, _ in held[at]) >= BLOCK:
                    out += full(at, BLOCK)
            count += len(ids)
            if count * width * 8 >= HELD_BYTES:
                out, count = out + [r for at in list(held) for r in full(at, 1)], 0
            if out:
                yield batch(out)
        for at in list(held):
            yield batch(list(full(at, 1)))

    made = stage(map_batches(vectors, blocks, "list int, ids binary, vectors binary, n long"), "ann-blocks")
    sizes = np.zeros(len(centre), np.int64)
    for r in made.groupBy("list").agg(F.sum("n").alias("n")).collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["n"]
    most = min(total, max(share * total, 2 * k + 2)) if len(centre) > 1 else total
    opening = min(most, max(OPENING * total, 2 * k + 2)) if len(centre) > 1 else total

    def probing(asked: DataFrame, low: float, high: float) -> DataFrame:
        """Partial results of `asked` (vec_id, embedding, least) in the lists that follow `low` nearer vectors, up to `high`."""

        def packs(batches):
            """Rows of one list each: ids, vectors and least scores of at most PACK queries that probe it."""
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                ids, x, least = b.column(0).to_numpy(), vectors_of(b.column(1)), b.column(2).to_numpy()
                order = np.argsort(-(unit(x) @ centre.T), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                probed = np.zeros(order.shape, bool)
                np.put_along_axis(probed, order, (before >= low) & (before < high), axis=1)
                out = []
                for at in np.flatnonzero(sizes):
                    own = np.flatnonzero(probed[:, at])
                    for part in (own[i : i + PACK] for i in range(0, len(own), PACK)):
                        out.append((int(at), ids[part].tobytes(), x[part].tobytes(), least[part].tobytes()))
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["list", "query_ids", "queries", "least"])

        def search(batches):
            import pyarrow as pa

            shaped = lambda raw: np.frombuffer(raw, np.float64).reshape(-1, width)
            for b in batches:
                for row in range(b.num_rows):  # one at a time: a row holds a block of vectors
                    ids, x, query_ids, q, least = (c[row].as_py() for c in b.columns)
                    found = scan(shaped(q), np.frombuffer(query_ids, np.int64), np.frombuffer(least, np.float64), shaped(x), np.frombuffer(ids, np.int64), turn, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

        packed = map_batches(asked, packs, "list int, query_ids binary, queries binary, least binary")
        pairs = made.join(packed, "list").select("ids", "vectors", "query_ids", "queries", "least")
        return map_batches(pairs, search, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # one query per id
    first = ranked(probing(asked.withColumn("least", F.lit(-2.0)), 0, opening))
    if opening >= most:
        return first
    first = stage(first, "ann-opening")
    radius = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    nearer = asked.join(radius, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    return ranked(first.drop("rank").unionByName(probing(nearer, opening, most)))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of each vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.pmod(F.col("vec_id"), F.lit(50)) == 0))
