"""BPE encoding and decoding with word ends, by a contiguous array of ranks per word.

A text is cut at special tokens, normalised (composed form, lower case) and split into words. A word is held as a
list of part ids and a list of the ranks of adjacent parts; the smallest rank is looked for, its boundary deleted
and the ranks beside it refreshed, until no pair has a rank. Words of more than `SHORT` parts, where scanning again
and again would be quadratic, keep the same order of merges in a heap.

Each task caches results by white-space-delimited chunk, up to a bound. Nothing is shuffled. A null text is empty.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches
from .byte_ids import byte_chars

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Parts up to which ranks are scanned.
SHORT = 128
NO_RANK = 1 << 62
BITS = 24

#: White space as the vocabulary's pattern has it (fixed value).
SPACE = r"\t-\r \x85\xa0  -     　"
AT_SPACE = regex.compile(f"[{SPACE}]+")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Separators that str.split() takes for white space and the pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Chunks(dict):
    def __init__(self, encode, entries: int):
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, chunk: str) -> tuple[str, str]:
        value = self.encode(chunk)
        if len(chunk) <= 64 and len(self) < self.entries:
            self[chunk] = value
        return value


class WordBpe:
    """Encoder and decoder of one task. `entries` bounds the cache (about 300 bytes each)."""

    def __init__(self, path: str, entries: int = 350_000):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: of a pair of part ids: the merge's rank, above the id of the merged part
        self.ranks = {self.ids[a] << BITS | self.ids[b]: r << BITS | self.ids[a + b] for r, (a, b) in enumerate(pairs)}
        self.chars = byte_chars()
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.chunks = _Chunks(self._chunk, entries)

    def merge(self, parts: list[int]) -> list[int]:
        """The parts of a word after all merges."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, mask = self.ranks.get, (1 << BITS) - 1
        ranks = [get(a << BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = least & mask
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << BITS | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] << BITS | parts[i + 1], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        get, mask, n = self.ranks.get, (1 << BITS) - 1, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or get(parts[i] << BITS | parts[j]) != rank:
                continue  # a neighbour has changed since
            parts[i], alive[j], after[i] = rank & mask, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(parts[k] << BITS | parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p, a in zip(parts, alive) if a]

    def word(self, word: str) -> list[int]:
        symbols = [self.chars[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return self.merge([self.ids[s] for s in symbols if s in self.ids])

    def _chunk(self, chunk: str) -> tuple[str, str]:
        words = (chunk,) if chunk.isalpha() else WORD.findall(chunk)
        ids = [i for w in words for i in self.word(w)]
        return " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def _segment(self, text: str) -> list[tuple[str, str]]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # case without regard to neighbours
        parts = [p for p in AT_SPACE.split(text) if p] if ODD_SPACE.search(text) else text.split()
        return list(map(self.chunks.__getitem__, parts))

    def encode(self, text: str | None) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text: tokens joined by spaces."""
        if not text:
            return "", ""
        if any(s in text for s in self.special):
            found = []
            for s in self.at_special.split(text):
                found += [(str(self.special[s]), s)] if s in self.special else self._segment(s)
        else:
            found = self._segment(text)
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids: list[int]) -> str:
        """Tokens of ids, joined by spaces; unknown ids are passed over."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and decoded of `docs` (doc_id, text), row by row."""

    def run(batches):
        import pyarrow as pa

        bpe = WordBpe(vocabulary)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                pairs = [bpe.encode(t) for t in part.column(1).to_pylist()]
                counts = [ids.count(" ") + 1 if ids else 0 for ids, _ in pairs]
                columns = [pa.array(counts, pa.int64())] + [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids", "decoded"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(narrow, run, "doc_id long, n_tokens long, ids string, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
