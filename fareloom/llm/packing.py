"""Packing of token streams into training sequences by order-preserving dynamic programming.

Documents of one input partition form one stream of ids in reading order. Cuts may stand after a document (free),
after a sentence (a small penalty), or, where neither is near, at any multiple of a grid (a larger penalty). The cuts
minimise padding plus penalties: with f the cost of the best packing up to a cut and W the window,
f[j] = penalty[j] + W - p[j] + min(f[i] + p[i] for p[i] >= p[j] - W), a sliding minimum kept in a monotone queue.
The stream is solved in blocks of bounded length; what follows the last cut of a block opens the next one.

No shuffle: a partition packs what it reads, so work spreads as the scan does, and a task that runs again gives the
same pieces. A null text counts as empty (its document is the end id alone). Repeated rows are packed like others.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches
from .byte_ids import ByteIds

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 2048
END_ID = 1
#: Cost of a cut, in tokens of padding: after a document, after a sentence, elsewhere.
PENALTY = (0.0, 1.0, 8.0)
#: Distance of the cuts that are offered inside long sentences.
GRID = 32
#: Tokens that are solved at once.
BLOCK = 1 << 17

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_cuts(positions: list[int], penalties: list[float], window: int, dense_from: int | None = None) -> list[int]:
    """Indexes of the cheapest cuts, from the first position to the last, or to the cheapest one in the last window.

    `dense_from`: index from which every token is a position, in the last block of a stream. There a sequence whose
    length is a power of two needs no padding, and the packing ends at the last position.
    """
    n = len(positions)
    cost, back = [0.0] * n, [0] * n
    sums = [0.0] * n  # cost + position: what the queue compares
    sums[0] = cost[0] + positions[0]
    queue = deque([0])
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = sums[i] + window - p
        if dense_from is not None and j >= dense_from:
            length = 1
            while length < window:
                k = j - length
                if k >= dense_from and cost[k] < best:
                    best, i = cost[k], k
                length *= 2
        cost[j], back[j] = best + penalties[j], i
        sums[j] = s = cost[j] + p
        while queue and sums[queue[-1]] >= s:
            queue.pop()
        queue.append(j)
    end = n - 1
    if dense_from is None:
        k = n - 1
        while k > 0 and positions[k] > positions[-1] - window:
            if cost[k] < cost[end]:
                end = k
            k -= 1
    cuts = [end]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids, doc_ends, sentence_end, window: int, last: bool):
    """Positions and penalties of possible cuts in a block, and the index from which every token is one."""
    import numpy as np

    total = len(ids)
    kind = np.full(total + 1, 3, np.int8)
    kind[np.flatnonzero(sentence_end[ids]) + 1] = 1
    kind[doc_ends] = 0
    kind[[0, total]] = 0
    at = np.flatnonzero(kind < 3)
    gaps = np.diff(at)
    for g in np.flatnonzero(gaps > GRID):  # cuts inside long sentences
        kind[at[g] + GRID : at[g + 1] : GRID] = 2
    dense = max(0, total - window)
    if last:
        tail = kind[dense:]
        tail[tail == 3] = 2
    at = np.flatnonzero(kind < 3)
    penalties = np.array(PENALTY)[kind[at]]
    penalties[-1] = 0.0
    return at.tolist(), penalties.tolist(), int(np.searchsorted(at, dense)) if last else None


class Packer:
    """Packs a stream of documents; yields pieces as tuples in the order of SCHEMA."""

    def __init__(self, pieces: dict[int, bytes], window: int, end_id: int, first_sequence: int):
        import numpy as np

        self.window, self.end, self.sequence = window, end_id.to_bytes(4, "little"), first_sequence
        self.sentence_end = np.zeros(max(pieces) + 2, bool)
        for i, piece in pieces.items():
            self.sentence_end[i] = piece.rstrip().endswith((b".", b"!", b"?")) or b"\n" in piece
        self.docs: list[list] = []  # doc_id, tokens, tokens already written, tokens in the buffer
        self.buffer, self.held = [], 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        ids += self.end
        n = len(ids) // 4
        self.docs.append([doc_id, n, 0, n])
        self.buffer.append(ids)
        self.held += n
        if self.held >= BLOCK:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        import numpy as np

        if not self.held:
            return
        raw = b"".join(self.buffer)
        ends = np.cumsum([d[3] for d in self.docs])
        positions, penalties, dense = candidates(np.frombuffer(raw, "<u4"), ends, self.sentence_end, self.window, last)
        cuts = [positions[i] for i in best_cuts(positions, penalties, self.window, dense)]
        doc, at = 0, 0
        for low, high in zip(cuts, cuts[1:]):
            while at < high:
                d = self.docs[doc]
                take = min(high - at, d[3])
                yield d[0], d[2], take, raw[4 * at : 4 * (at + take)], d[1], self.sequence, at - low
                d[2], d[3], at = d[2] + take, d[3] - take, at + take
                doc += d[3] == 0
            self.sequence += 1
        self.docs, self.buffer, self.held = self.docs[doc:], [raw[4 * at :]], self.held - at


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (doc_id, text; other columns are ignored) with their ids, little-endian unsigned 32 bit.

    A piece is a run of one document's ids in one sequence. `start` is the number of the document's ids before it,
    `offset` its place in the sequence. Every id, with the end id of each document, lies in exactly one piece.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = ByteIds(vocabulary)
        packer = Packer(encode.pieces, window, end_id, TaskContext.get().partitionId() << 40)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []

        def batch():
            columns = list(zip(*rows)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.extend(packer.add(doc_id, encode(text)))
                if len(rows) >= 4096:
                    yield batch()
        rows.extend(packer.flush())
        yield batch()

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
