"""WARC archives: pages written as segmented, chunk-framed records and put together again.

Writing. Each page is one record: a `response` with an HTTP head and the payload in chunked transfer framing, or a
`revisit` with the HTTP head alone that names the response it repeats. A record whose block is longer than
`SEGMENT` bytes is cut: the record itself holds the first piece and `WARC-Segment-Number: 1`, `continuation` records
with the next numbers hold the rest and name the record in `WARC-Segment-Origin-ID`; the last one states
`WARC-Segment-Total-Length`. Every record is a gzip member. A task closes an archive at `ARCHIVE` bytes, also between
segments of one record, so pieces lie in different archives. Archives are rows (archive, content) of a table.

Reading takes any table of `content`, gzipped or plain, also Spark's `binaryFile` rows of real archives. Records without
segments need no shuffle. Continuation records are grouped by origin identifier and ordered by segment number; a record is
whole if its numbers run from 1 without gap or repeat and the pieces' lengths add up to the stated total. Then the HTTP
head is split off, chunked framing is undone, and the payload's digest is compared with `WARC-Payload-Digest`.
`damage` names what failed (length: a block ends early, segments, framing, digest) and is null otherwise; no record is
dropped. Of an archive that isn't gzip to its end, what can be unpacked is read.

Of pages with equal payloads of at least `least` bytes, those with the largest page_id are responses. Payloads are equal
when their SHA-256 is. Payload groups are cut by a hash of the page_id before the largest id is looked up, so a payload
that a third of all pages have is spread. A null html is an empty payload, a null url an empty target. Rows that repeat
a page_id are records of their own, and if they are the largest all of them are responses. Null page_ids are smaller than
every other; a revisit of such a page refers to null. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.session import stage

from .batches import map_batches

SEGMENT = 8 << 10
ARCHIVE = 4 << 20
CHUNK = 4 << 10
SALTS = 1024
FED = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, type string, page_id long, refers_to long, digest string, origin_id string, segment long, total long, damage string, block binary"
)
PAGES = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, damage string"


# --- Records ------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts] + [b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunk-framed body, with or without chunk extensions and trailers; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        length, at = int(size, 16), end + 2
        if not length:
            trailer = body[at:]
            return b"".join(parts) if trailer == b"\r\n" or trailer.endswith(b"\r\n\r\n") else None
        if body[at + length : at + length + 2] != b"\r\n":
            return None
        parts.append(body[at : at + length])
        at += length + 2


def name_of(page_id: int | None, digest: str) -> str:
    """URN of a page with its payload: what a revisit refers to. A record's own id adds a fragment."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    head = "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members_of(page_id, url, payload: bytes, first, serial: int, revisit: bool, segment: int) -> Iterator[bytes]:
    """The record of a page and its continuations, compressed."""
    digest = base32_sha1(payload)
    own = f"<{name_of(page_id, digest)}#{serial}>"
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")  # no line end may leave the field
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{name_of(first, digest)}>")]
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload)
    else:
        block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield member(headers, block)
        return
    yield member([*headers, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}.{n}>"), ("WARC-Date", DATE)]
        more += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n)]
        yield member(more + ([("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []), piece)


def unpacked(content) -> Iterator[bytes]:
    """The gzip members of an archive one by one, each whole; plain content as it is."""
    view = memoryview(content).cast("B")
    if view[:2] != b"\x1f\x8b":
        yield bytes(view)
        return
    at = 0
    while at < len(view):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof and at < len(view):
            fed = view[at : at + FED]
            try:
                parts.append(reader.decompress(fed))
            except zlib.error:
                at = len(view)
                break
            at += len(fed) - len(reader.unused_data)
        yield b"".join(parts)
        while at < len(view) and view[at : at + 2] != b"\x1f\x8b":  # padding between members
            at += 1


def records_of(content) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    for text in unpacked(content):
        at = text.find(b"WARC/")
        while at >= 0:
            end = text.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = text[at:end].decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            length = fields.get("content-length", "")
            length = int(length) if length.isdigit() else 0
            yield fields, text[end + 4 : end + 4 + length]
            at = text.find(b"WARC/", end + 4 + length)


def page_of(urn: str | None) -> int | None:
    """The page_id in a record's name."""
    part = (urn or "").strip("<>").split(":")
    return int(part[2]) if len(part) > 3 and part[:2] == ["urn", "page"] and part[2].lstrip("-").isdigit() else None


def decoded(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload of an HTTP response, None if its framing is broken, and the length its head states."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    length = fields.get(b"content-length", b"")
    payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    return payload, int(length) if length.isdigit() else None


# --- Tables -------------------------------------------------------------------------------------------


def with_first(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, first (largest page_id of the same payload) and revisit.

    Per payload and slice of page_ids there is one row with the largest id; of these, at most `SALTS` a payload, the
    largest is taken and goes back to its slices, and from there to the rows.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({
        "same": F.sha2("payload", 256),
        "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"),
    })
    slices = rows.where(F.length("payload") >= least).groupBy("same", "salt").agg(F.max("page_id").alias("own"))
    largest = slices.groupBy("same").agg(F.max("own").alias("first"))
    firsts = slices.join(largest, "same").select("same", "salt", "first")
    out = rows.join(firsts, ["same", "salt"], "left")
    return out.select("page_id", "url", "payload", "first", F.coalesce(F.col("page_id").isNull() & F.col("first").isNotNull() | (F.col("page_id") < F.col("first")), F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, least: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """(archive, content) of `pages` (page_id, url, html)."""

    def function(batches: Iterator):
        import pyarrow as pa

        held, size = [], 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

        for b in batches:
            for row in range(b.num_rows):
                page_id, url, payload, first, revisit, serial = (c[row].as_py() for c in b.columns)
                for m in members_of(page_id, url, payload, first, serial, revisit, segment):
                    held.append(m)
                    size += len(m)
                    if size >= archive:
                        yield closed()
                        held, size = [], 0
        if held:
            yield closed()

    numbered = with_first(pages, least).withColumn("serial", F.monotonically_increasing_id())
    written = map_batches(numbered, function, "content binary")
    name = F.format_string("pages-%012d.warc.gz", F.monotonically_increasing_id())
    return written.select(name.alias("archive"), "content")


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of `archives` (content), as `RECORDS`."""

    def function(batches: Iterator):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        number = lambda text: int(text) if text and text.isdigit() else None
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in records_of(content.as_buffer() if content.is_valid else b""):
                    record = f.get("warc-record-id")
                    digest = f.get("warc-payload-digest", "").partition(":")[2] or None
                    rows.append((record, f.get("warc-type"), page_of(record), page_of(f.get("warc-refers-to")), digest,
                                 f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")),
                                 number(f.get("warc-segment-total-length")),
                                 None if len(block) == number(f.get("content-length")) else "length", block))
                    size += len(block)
                    if size >= ARCHIVE:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return map_batches(archives.select("content"), function, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with all their `blocks` in order and `damage`: 'segments' where the pieces don't make up the stated record.

    Continuations of a record that no archive holds stay as a row of type `continuation`.
    """
    kept = ["record_id", "type", "page_id", "refers_to", "digest", "damage"]
    alone = records.where("segment is null").select(*kept, F.array("block").alias("blocks"))
    pieces = records.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    grouped = pieces.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("damage").alias("damage"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest")],
    )
    lengths = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    whole = F.coalesce(in_order & (lengths == F.col("total")), F.lit(False))
    joined = grouped.withColumns({
        "record_id": F.col("origin"),
        "type": F.coalesce("type", F.lit("continuation")),
        "damage": F.coalesce("damage", F.when(~whole, "segments")),
        "blocks": F.transform("parts", lambda p: p["block"]),
    })
    return alone.unionByName(joined.select(*kept, "blocks"))


def payloads(records: DataFrame) -> DataFrame:
    """Responses and revisits with payload length, digest and damage, as `PAGES`."""

    def function(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            rows = []
            for row in range(b.num_rows):
                record, kind, page, refers, digest, blocks, damage = (c[row].as_py() for c in b.columns)
                payload, stated = decoded(b"".join(blocks))
                if kind == "revisit":
                    rows.append((record, page, stated, digest, kind, refers, damage))
                    continue
                found = base32_sha1(payload) if payload is not None else None
                if payload is None:
                    damage = damage or "framing"
                elif digest and found != digest:
                    damage = damage or "digest"
                rows.append((record, page, None if payload is None else len(payload), found, kind, None, damage))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in PAGES.split(", ")])

    kept = records.where(F.col("type").isin("response", "revisit"))
    return map_batches(kept.select("record_id", "type", "page_id", "refers_to", "digest", "blocks", "damage"), function, PAGES)


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = stage(write_archives(pages), "warc-archives")
    return payloads(reassemble(read_records(archives))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "damage")


OP11_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest
  FROM pages)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to,
  NULL::VARCHAR AS damage
FROM p
WINDOW w AS (PARTITION BY payload)
"""
