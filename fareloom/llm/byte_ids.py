"""Byte-level BPE ids of whole texts, the same as the tokenizers library gives, with a cache of chunks."""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array

#: How text is split before the merges (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters that are no white space: no token crosses it leftwards.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Where no two white characters are neighbours, every space inside a text is a lone one.
WHITE_RUN = re.compile(r"\s\s")
#: Longer chunks are encoded without being kept.
CACHED_CHARS = 64
#: Characters that both libraries put into the same classes lie below this one.
BEYOND = "ɐ"
#: Long texts are cut at the next lone space after so many characters, which bounds the lists of ids.
STRETCH = 1 << 16


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class _Chunks(dict):
    """Ids (little-endian unsigned 32 bit) of " " + chunk; computed on a miss, kept up to `entries`."""

    def __init__(self, encode, entries: int):
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(" " + chunk)
        if len(chunk) <= CACHED_CHARS and len(self) < self.entries:
            self[chunk] = ids
        return ids


class ByteIds:
    """Encoder of one task. `entries` bounds the cache (about 150 bytes each)."""

    def __init__(self, path: str, entries: int = 200_000):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        back = {c: b for b, c in byte_chars().items()}
        special = {t["content"]: t["id"] for t in config["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in config["model"]["vocab"].items() if t not in special}
        self.pieces = {i: b for b, i in ranks.items()}
        self.special = {content: struct.pack("<I", i) for content, i in special.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.plain = path, None
        self.chunks = _Chunks(self._encode, entries)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def _tokenizer(self):
        """The library's own tokenizer, loaded when the first text needs it."""
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
            self.plain.no_truncation()
            self.plain.no_padding()
        return self.plain

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        # both libraries agree where character classes are beyond doubt; elsewhere the tokenizer itself decides
        if text.isascii() or max(text) < BEYOND:
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self._tokenizer().encode(text, add_special_tokens=False).ids
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _segment(self, text: str) -> bytes:
        """Plain texts go through whole, stretch by stretch; others word by word, so that only odd words are slow."""
        if text.isascii() or max(text, default="") < BEYOND:
            cuts = [0]
            while len(text) - cuts[-1] > STRETCH and (found := LONE_SPACE.search(text, cuts[-1] + STRETCH)):
                cuts.append(found.start())
            return b"".join(self._encode(text[a:z]) for a, z in zip(cuts, [*cuts[1:], len(text)]))
        first, *rest = LONE_SPACE.split(text) if WHITE_RUN.search(text) else text.split(" ")
        return self._encode(first) + b"".join(map(self.chunks.__getitem__, rest))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._segment(text)
        return b"".join(self.special[s] if s in self.special else self._segment(s) for s in self.at_special.split(text))
