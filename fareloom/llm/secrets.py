"""Secrets in whole texts: three patterns, and encoded keys and signed tokens that are confirmed by their structure.

assign, access and hex are the leftmost matches that don't overlap others of their kind; matches that are too short
are dropped after matching. Beyond them, runs of base64 or hex characters are decoded and parsed: `private_key` if the
bytes are a key encoding whose nested lengths fill it exactly, `signed_token` if header and payload of a dotted token
decode to objects and the header names an algorithm.

Base64 of a key may be broken by white space, quotes, line prefixes and backslash escapes, with or without key
markers: its own lengths tell how many characters belong to it. It begins after, and ends before, a character that is
no letter or digit. Inside a confirmed pair of markers only an unbroken run is a span of its own.

Positions are code points, ends exclusive. Spans are ordered by start, then by kind as listed in KINDS. A null text
counts as empty. No shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches

KINDS = ("assign", "access", "hex", "private_key", "signed_token")
BASE = KINDS[:3]
MASK = "[SECRET]"

# Fixed patterns. ASCII: letters match in either case without other scripts' look-alikes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is a leftmost match of [0-9a-f]+ of that length

MARKED_KEY = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([^-]*(?:-(?!----)[^-]*)*)-----END \1PRIVATE KEY-----")
MARKED_HEADER = re.compile(r"[A-Za-z-]+: [^\n\\]*")
#: First characters of a sequence of 32 bytes or more, and of the openssh container.
KEY_START = re.compile(r"M[C-I](?:(?<![A-Za-z0-9]..)|(?<=\\[nrt]..)|(?<=\\u00[0-9A-Fa-f]{2}..))")
CONTAINER_START = re.compile(r"b3Bl(?:(?<![A-Za-z0-9]....)|(?<=\\[nrt]....)|(?<=\\u00[0-9A-Fa-f]{2}....))")
#: Base64 characters (group 1, escaped ones in 2 and 3), or what may stand between two lines of them.
PIECE = re.compile(r"""["']\s*\+\s*["']|\\+[nrt]|\\+u000[9aAdD]|([A-Za-z0-9+/_-]+)|\\+(/)|\\+u00(2[bBfF])|[\s"',>#|*\\]""")
PADDING = re.compile(r"(?:=|\\+u003[dD]){0,2}")
BROKEN_PADDING = {n: re.compile(r"""(?:(?:\\+[nrt]|[\s"',>#|*\\])*(?:=|\\+u003[dD])){%d}""" % n) for n in (1, 2, 3)}
HEX_RUN = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=\\[nrt]))(?:0[xX])?([0-9A-Fa-f]{64,})(?![0-9A-Za-z])")
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
DOTTED = re.compile(r"\.(?=([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
BYTE_MARKS = (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")
TOKEN_CUT = re.compile(r"[_-]")
OPENSSH = b"openssh-key-v1\0"
#: Most elements of a level of a key, and most keys of a container; the layouts in use have ten and one.
MOST_ELEMENTS = 64
INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


Read = Callable[[int, int], bytes]  # (offset, length) -> bytes of what is examined


def elements(read: Read, low: int, high: int, most: int = MOST_ELEMENTS) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the contents of at most `most` elements that fill [low, high) exactly, or None.

    Only tags and lengths are read, so a claimed length costs nothing.
    """
    found, at = [], low
    while at < high:
        if len(found) == most or at + 2 > high:
            return None
        tag, size = read(at, 2)
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > high:
                return None
            size, at = int.from_bytes(read(at, n), "big"), at + n
            if size < 0x80:
                return None
        if at + size > high:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_key(read: Read, size: int) -> bool:
    """A private key by its encoding: a sequence of the layouts in use, or the openssh container with its lengths."""
    if size < 32:
        return False
    number = lambda at: int.from_bytes(read(at, 4), "big")
    if read(0, len(OPENSSH)) == OPENSSH:
        at = len(OPENSSH)
        for _ in range(3):  # cipher, derivation, its options
            at += 4 + number(at)
            if at + 4 > size:
                return False
        return number(at) >= 1
    outer = elements(read, 0, size, 1)
    inner = elements(read, *outer[0][1:]) if outer and outer[0][0] == SEQUENCE else None
    if not inner or len(inner) < 3:
        return False
    tags = [t for t, _, _ in inner]
    _, low, high = inner[0]
    version = read(low, 1) if high - low == 1 else b""
    if tags[:9] == [INTEGER] * 9:  # numbers of a key with their version
        return version in (b"\0", b"\1") and len(inner) <= 10
    if tags[:6] == [INTEGER] * 6 and len(inner) == 6:
        return version == b"\0"
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and version in (b"\0", b"\1"):  # algorithm, then the key
        algorithm = elements(read, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID
    return tags[:2] == [INTEGER, OCTETS] and version == b"\1" and inner[1][2] - inner[1][1] >= 20  # a curve's number


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and is_key(lambda at, n: data[at : at + n], len(data))


def required(read: Read, have: int) -> int | None:
    """Bytes that a key needs as far as the lengths among its first `have` bytes, 15 or more, tell; None if it is none."""
    if read(0, len(OPENSSH)) == OPENSSH:
        at, keys = len(OPENSSH), 0
        for part in range(3 + 1 + MOST_ELEMENTS + 1):  # cipher, derivation, its options; number; public keys, private part
            if at + 4 > have:
                return at + 4
            value = int.from_bytes(read(at, 4), "big")
            if part == 3:
                keys, at = value, at + 4
                if not keys:
                    return None
                if keys > MOST_ELEMENTS:
                    return 1 << 62  # more than any text holds
                continue
            at += 4 + value
            if part == 4 + keys and part > 3:
                break
        return at
    head = read(0, 9)
    size, at = head[1], 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return None
        size, at = int.from_bytes(head[at : at + n], "big"), at + n
    # every layout begins with a version of one byte
    return at + size if head[0] == SEQUENCE and head[at : at + 2] == b"\2\1" and head[at + 2] <= 1 else None


def character(m: re.Match) -> str:
    """The base64 characters of a PIECE."""
    return m[1] or m[2] or (chr(int(m[3], 16)) if m[3] else "")


class Run:
    """A stretch of base64 with what may stand between its lines, taken apart once for all keys that may begin in it.

    `chars` are its base64 characters. Of each piece of them: place in the text, place among the characters, whether it
    stands as it is, and how many separators came before.
    """

    def __init__(self, text: str, start: int):
        self.text, self.places, self.ends, self.firsts, self.plain, self.before, self.gaps = text, [], [], [], [], [], []
        parts, n, at = [], 0, start
        while m := PIECE.match(text, at):
            piece, at = character(m), m.end()
            if not piece:
                self.gaps.append(m.start())
                continue
            self.places.append(m.start())
            self.ends.append(at)
            self.firsts.append(n)
            self.plain.append(m[1] is not None)
            self.before.append(len(self.gaps))
            parts.append(piece)
            n += len(piece)
        self.chars, self.end = "".join(parts), max(at, start + 1)

    def reader(self, first: int) -> Read:
        """Decoded bytes from the character `first` on; only what is asked for is decoded."""

        def read(at: int, n: int) -> bytes:
            low = at // 3
            data = from_base64(self.chars[first + 4 * low : first + 4 * (-(-(at + n) // 3))]) or b""
            return data[at - 3 * low : at - 3 * low + n]

        return read

    def key_end(self, start: int) -> tuple[int, bool] | None:
        """End of the base64 key that begins at `start`, and whether it is one unbroken run."""
        own = bisect_right(self.places, start) - 1
        if own < 0 or start >= self.ends[own]:
            return None
        first = self.firsts[own] + (start - self.places[own] if self.plain[own] else 0)
        read, left = self.reader(first), len(self.chars) - first
        have = left * 3 // 4
        if have < len(OPENSSH):
            return None
        need = required(read, have)
        if need is None:
            return None
        container = read(0, len(OPENSSH)) == OPENSSH
        if need > have:
            if not container:
                return None
            # cut off: what the first stretch shows
            gap = bisect_left(self.gaps, start)
            end = self.gaps[gap] if gap < len(self.gaps) else self.ends[-1]
            last = bisect_left(self.places, end) - 1
            shown = self.firsts[last] + (self.ends[last] - self.places[last] if self.plain[last] else 1) - first
            return (PADDING.match(self.text, end).end(), True) if is_key(read, shown * 3 // 4) else None
        count = (need * 4 + 2) // 3
        last = bisect_right(self.firsts, first + count - 1) - 1
        at, broken = self.ends[last], self.before[last] != self.before[own]
        width = at - self.places[last] if self.plain[last] else 1
        # the container's lengths may leave some of its last run over
        n = self.firsts[last] + width - first
        end = at if container else at - (n - count)
        size = (n - (n % 4 == 1)) * 3 // 4 if container else count * 3 // 4
        if end < at and self.text[end] not in "+/-_" or not is_key(read, size):
            return None
        if end < at:
            return end, not broken
        padding = PADDING.match(self.text, end)
        if broken and padding.end() - end < -n % 4:  # a line may break in it
            padding = BROKEN_PADDING[-n % 4].match(self.text, end) or padding
        return padding.end(), not broken


def private_keys(text: str) -> list[tuple[int, int]]:
    found, marked = set(), []
    if "PRIVATE KEY-----" in text:
        for m in MARKED_KEY.finditer(text):
            body = MARKED_HEADER.sub("", m[2])
            if is_private_key(from_base64("".join(map(character, PIECE.finditer(body))))):
                marked.append(m.span())
    for pattern in (KEY_START, CONTAINER_START):
        end, run = 0, None
        for m in pattern.finditer(text):
            if m.start() < end:
                continue
            if run is None or m.start() >= run.end:
                run = Run(text, m.start())
            if key := run.key_end(m.start()):
                end = key[0]
                if key[1] or not any(a <= m.start() < b for a, b in marked):
                    found.add((m.start(), end))
    found.update(m.span() for m in HEX_RUN.finditer(text) if len(m[1]) % 2 == 0 and is_private_key(bytes.fromhex(m[1])))
    return sorted(found | set(marked))


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Dotted triples from left to right, each header also tried behind its dashes and underscores."""
    found, end = [], 0
    for m in DOTTED.finditer(text):
        dot = m.start()
        low = max(end, text.rfind(".", 0, dot) + 1)
        low += len(text[low:dot].rstrip(TOKEN))
        cuts = [low, *(low + c.end() for c in TOKEN_CUT.finditer(text[low:dot]))]
        if low and text[low - 1] == "\\" and text[low] in "nrt":
            cuts.insert(1, low + 1)
        payload, decoded = None, {}
        for at in cuts:
            if dot - at < 14:  # {"alg":""}
                break
            lead = from_base64(text[at : at + 4]) or b""
            if not (lead.startswith(BYTE_MARKS) or lead.lstrip(b" \t\r\n\0")[:1] in (b"{", b"")):
                continue
            # cuts a multiple of four characters apart share what they decode to, and all share the payload
            if (dot - at) % 4 not in decoded:
                decoded[(dot - at) % 4] = at, from_base64(text[at:dot]) or b""
            origin, header = decoded[(dot - at) % 4]
            if header.rstrip(b" \t\r\n\0")[-1:] != b"}":
                continue
            payload = is_object(from_base64(m[1])) if payload is None else payload
            if payload and is_object(header[(at - origin) // 4 * 3 :], "alg"):
                end = m.end(2)
                found.append((at, end))
                break
    return found


def is_object(data: bytes | None, named: str | None = None) -> bool:
    """Whether bytes are a JSON object, and the value of `named` in it a text."""
    try:
        value = json.loads(data or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (named is None or isinstance(value.get(named), str))


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, in order."""
    if not text:
        return []
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("private_key", *s) for s in private_keys(text)]
    spans += [("signed_token", *s) for s in signed_tokens(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row of `docs` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(narrow, run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def masked(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by MASK."""
    spans = find(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, low, high in spans:
        if low >= end:
            out += [text[at:low], MASK]
        at = end = max(end, high)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with secrets replaced in `text`; rows and other columns stay."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        import pyarrow as pa

        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts = pa.array([masked(t) for t in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names)

    return map_batches(docs, run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, spans and a digest of the base spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, written), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
