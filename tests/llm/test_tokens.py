"""Token operators against the libraries whose results they must give, and the packer against brute force."""

from __future__ import annotations

import itertools
import random
import zlib

import pytest
import sentencepiece
from fareloom.llm import bpe, byte_ids, packing, token_counts
from fareloom.llm.byte_ids import ByteIds
from tokenizers import Tokenizer

TEXTS = [
    "", " ", "  ", "a", "The quick brown fox, isn't it? 123 4567", "tabs\tand\n\nlines \n  and   runs   ", "\x1c\x1d odd\x1fspaces\x85here\xa0too",
    "ΣΑΣ ΟΔΟΣ İstanbul STRASSE ß", "été Ångström ﬁ", "日本語のテキスト 中文 한국어", "emoji 👩‍👩‍👧 🇩🇪 ​ zero", "x" * 700 + " " + "ab" * 400,
    "<|endoftext|> in <|startoftext|>text<|endoftext|>", "<|endoftext|", "'s 't're'LL we'll I'D", "a\n b", "a \nb", "a  \nb", "a \n\n  b", "\n", " a ", "▁ mark ▁▁x",
    "\U0010ffff  ͸", "line sep　wide", "1²½Ⅷ ٣", "_under_score__", "a" * 5000,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab '\n\t .,Σé1語<|") for _ in range(rng.randrange(60))) for _ in range(300)]
    return TEXTS + mixed + [r.text for r in rows]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, start string")


def test_byte_ids(texts):
    plain, own = Tokenizer.from_file(packing.VOCABULARY), ByteIds(packing.VOCABULARY, entries=50)
    for t in texts:
        want = b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids)
        assert own(t) == want, t[:80]


def test_byte_ids_of_mixed_white_runs():
    plain, own = Tokenizer.from_file(packing.VOCABULARY), ByteIds(packing.VOCABULARY)
    white = [" ", "\xa0", "\n", "\t", "\x85", "\x1c", "\u2003", "\u3000", "\u2028", "\u180e", "\u200b", "\ufeff"]
    runs = ["".join(r) for n in range(1, 4) for r in itertools.product(white, repeat=n)] + [" \xa0" * n for n in range(2, 40)]
    for t in [f"a{r}b" for r in runs] + [f"é {r}" for r in runs] + [f"{r}1 x" for r in runs] + ["a \xa0 \xa0 b", "<|endoftext|> \xa0 \xa0<|endoftext|>"]:
        want = b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids)
        assert own(t) == want, repr(t)


def test_byte_ids_of_long_texts(monkeypatch):
    monkeypatch.setattr(byte_ids, "STRETCH", 7)
    plain, own, rng = Tokenizer.from_file(packing.VOCABULARY), ByteIds(packing.VOCABULARY), random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab  '\n\t\xa0.,1é") for _ in range(rng.randrange(120)))
        want = b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids)
        assert own(t) == want, repr(t)


def test_word_bpe(spark, texts):
    plain = Tokenizer.from_file(bpe.VOCABULARY)
    plain.no_truncation(), plain.no_padding()
    got = {r.doc_id: r for r in bpe.encode(frame(spark, [*texts, None])).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = plain.encode(t, add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)), t[:80]
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == plain.decode(ids, skip_special_tokens=False)
    own = bpe.WordBpe(bpe.VOCABULARY)
    assert own.decode([0, 49407, 10**6]) == plain.decode([0, 49407], skip_special_tokens=False)


def test_short_and_long_merges_agree():
    own, rng = bpe.WordBpe(bpe.VOCABULARY), random.Random(1)
    for _ in range(200):
        word = [own.ids[rng.choice("abtheinor")] for _ in range(rng.randrange(1, 100))]
        assert own.merge(list(word)) == own._merge_long(list(word))


def unigram(pieces, byte_fallback: bool):
    """The library's own unigram model over given pieces: whole texts, extra spaces kept."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    kinds = pb.ModelProto.SentencePiece
    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = pb.TrainerSpec.UNIGRAM, byte_fallback
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = True, False
    proto.normalizer_spec.escape_whitespaces = True
    names = [("<unk>", 0.0, kinds.UNKNOWN)] + ([(f"<0x{b:02X}>", 0.0, kinds.BYTE) for b in range(256)] if byte_fallback else [])
    for piece, score, kind in names + [(p, x, kinds.NORMAL) for p, x in pieces.items()]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


RUNS = [a + " " * n + b for n in range(1, 21) for a, b in (("x", "y"), ("", "y"), ("x", ""), ("", ""), ("the\n", "of  it"))]
RUNS += ["x    y", "a        b c  d", "hello   world", " a", "  a ", "a \u2581 \u2581\u2581b", " \xa0  \t  b"]


def test_token_counts(spark, texts):
    """The library adds scores in single precision: whole texts are compared with small whole scores, which both add exactly."""
    pieces, fallback = token_counts.load_pieces(token_counts.VOCABULARY)
    assert fallback
    small = {p: -float(zlib.crc32(p.encode()) % 97 + 1) for p in pieces}
    plain, own, every = unigram(small, fallback), token_counts.Viterbi(small, fallback), [*texts, *RUNS]
    for t in every:
        ids = plain.encode(t)
        count, score = own.text(t)
        assert count == len(ids), t[:80]
        if not any(x <= 256 for x in ids):
            assert score == sum(plain.get_score(x) for x in ids)
    real, short = unigram(pieces, fallback), [t for t in every if len(t) < 200 and all(c in pieces for c in t.replace(" ", "▁"))]
    assert len(short) > 80
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, [*short, None])).collect()}
    for i, t in enumerate([*short, ""]):
        # the library's lattice; its faster plain encoding misses the best path of scores as far apart as these
        first, *other = [(sum(real.get_score(x) for x in ids), len(ids)) for ids in real.nbest_encode_as_ids(t, 2)] if t else [(0.0, 0)]
        assert got[i].score == first[0], t
        assert got[i].n_tokens == first[1] or other[0] == (first[0], got[i].n_tokens), t


def test_ties_and_unknown_runs():
    pieces = {"▁": -1.0, "▁▁": -1.5, "a": -1.0, "b": -1.0, "ab": -2.0, "abc": -3.0, "bc": -2.0, "aba": -1.5}
    for fallback in (False, True):
        plain, own = unigram(pieces, fallback), token_counts.Viterbi(pieces, fallback)
        for n in range(1, 6):
            for t in map("".join, itertools.product("abcé ", repeat=n)):
                assert own.text(t)[0] == len(plain.encode(t)), (t, fallback)


def test_pieces_across_words_keep_texts_whole():
    pieces = {"▁": -3.0, "a": -3.0, "b": -3.0, "a▁b": -1.0, "▁a": -4.0}
    plain, own = unigram(pieces, False), token_counts.Viterbi(pieces, False)
    for t in map("".join, itertools.product("ab ", repeat=5)):
        assert own.text(t)[0] == len(plain.encode(t)), t


def check_pieces(rows, want: dict, window: int) -> int:
    """Every id once, sequences gapless and within the window; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == want[d]
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        assert {p.doc_tokens for p in pieces} == {len(want[d]) // 4}
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        n = sum(p.length for p in pieces)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding


def test_packing(spark, texts):
    docs = frame(spark, [*texts, None]).repartition(2)
    plain = Tokenizer.from_file(packing.VOCABULARY)
    raw = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    want = {i: raw([*plain.encode(t, add_special_tokens=False).ids, 1]) for i, t in enumerate([*texts, ""])}
    rows = packing.pack(docs).collect()
    assert check_pieces(rows, want, 2048) < 0.01 * sum(map(len, want.values())) / 4
    query = packing.op5_packing(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in query}) == 200
    assert all(r.ids_crc32 == zlib.crc32(bytes(p.ids)) for r, p in zip(sorted(query), sorted(packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())))


def test_cuts_are_the_cheapest():
    rng, window = random.Random(3), 12
    for _ in range(60):
        positions = [0, *itertools.accumulate(rng.randrange(1, 6) for _ in range(9))]
        penalties = [0.0, *(rng.choice((0.0, 1.0, 8.0)) for _ in positions[1:-1]), 0.0]
        dense = rng.choice((None, len(positions) - 1))
        cuts = packing.best_cuts(positions, penalties, window, dense)

        def cost(path):
            if any(positions[b] - positions[a] > window for a, b in zip(path, path[1:])):
                return float("inf")
            return sum(window - positions[b] + positions[a] + penalties[b] for a, b in zip(path, path[1:]))

        inner = range(1, cuts[-1])
        every = (cost([0, *c, cuts[-1]]) for k in range(len(inner) + 1) for c in itertools.combinations(inner, k))
        assert cost(cuts) == min(every)


def test_small_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    own, rng = ByteIds(packing.VOCABULARY), random.Random(2)
    packer, rows, want = packing.Packer(own.pieces, 64, 1, 0), [], {}
    for d in range(200):
        ids = own(" ".join(rng.choice(["word.", "other", "third!"]) for _ in range(rng.randrange(90))))
        want[d] = ids + b"\1\0\0\0"
        rows += packer.add(d, ids)
    rows += packer.flush()
    names = [c.split()[0] for c in packing.SCHEMA.split(", ")]
    rows = [type("Row", (), dict(zip(names, r))) for r in rows]
    assert check_pieces(rows, want, 64) < 0.05 * sum(map(len, want.values())) / 4


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert packing.pack(nothing).count() == 0
    assert bpe.encode(nothing).count() == 0
    assert token_counts.token_counts(nothing).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.encode(rows).collect()) == [0, 2, 2]
    assert sum(r.length for r in packing.pack(rows).collect()) == 7
    assert token_counts.token_counts(rows).where("doc_id is null").count() == 2
