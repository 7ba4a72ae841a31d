"""Token counts of a unigram vocabulary without making the tokens: count-only Viterbi.

Spaces become U+2581, and one more stands before the text. It is cut before each run of marks, where no piece of the
vocabulary can cross (a vocabulary with such a piece is taken whole); a run stays with the word that follows. Within a word an
Aho-Corasick automaton lists every vocabulary piece that ends at each character; the dynamic program carries the best
score and the number of pieces of the best path only. Ties go to the piece that starts first, as in the tokenizer: a
later candidate replaces an earlier one only if it is strictly better. A character that is no piece by itself may be
unknown, at the least score of the vocabulary minus 10; it counts as its UTF-8 bytes where the vocabulary has byte
pieces, else a run of unknowns counts as one.

Each task caches words up to a bound. Nothing is shuffled. Null and empty texts have no token and score 0.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: A run of marks with the word that follows, or a run at the end.
WORD = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Ordinary pieces with their scores, and if the vocabulary falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i): float(model.get_score(i)) for i in ids if not odd(i)}
    return pieces, sum(model.is_byte(i) for i in ids) == 256


class _Words(dict):
    def __init__(self, best, entries: int):
        super().__init__()
        self.best, self.entries = best, entries

    def __missing__(self, word: str) -> tuple[int, float]:
        value = self.best(word)
        if len(word) <= 64 and len(self) < self.entries:
            self[word] = value
        return value


class Viterbi:
    def __init__(self, pieces: dict[str, float], byte_fallback: bool, entries: int = 500_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min([0.0, *pieces.values()]) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.words = _Words(self.best, entries)
        self.whole = any(MARK in piece.lstrip(MARK) for piece in pieces)

    def best(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path through a word."""
        n = len(word)
        ending: list[list] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):  # of one end the longest first, so the earliest start first
            ending[last + 1].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, at, single = float("-inf"), 0, False
            for length, piece in ending[end]:
                s = score[end - length] + piece
                if s > top:
                    top, at = s, length
                single = single or length == 1
            if not single and score[end - 1] + self.unknown > top:
                top, at = score[end - 1] + self.unknown, 0
            score[end] = top
            if at:
                count[end] = count[end - at] + 1
            else:
                unknown[end] = True
                new = len(word[end - 1].encode()) if self.byte_fallback else int(not unknown[end - 1])
                count[end] = count[end - 1] + new
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        words = [marked] if self.whole else WORD.findall(marked)
        found = list(map(self.words.__getitem__, words))
        return sum([f[0] for f in found]), sum([f[1] for f in found])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and score of the best path of every row of `docs` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        viterbi = Viterbi(*load_pieces(vocabulary))
        for b in batches:
            found = [viterbi.text(t) for t in b.column(1).to_pylist()]
            counts, scores = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), counts, scores], ["doc_id", "n_tokens", "score"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(narrow, run, "doc_id long, n_tokens long, score double")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
