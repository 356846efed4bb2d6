"""WARC archives: one gzip member per record, written and read as a stream.

The reader is sequential and incremental: compressed bytes are inflated member by member as they come, a record's header
is parsed as soon as it is whole, the payload is framed by Content-Length, and block and payload digests are verified.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written

#: Compressed bytes after which a task closes an archive and opens the next.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes of one row of an archive table; the archive is the concatenation of its rows.
PIECE_BYTES = 1 << 20
LEVEL = 3
#: Archives that a task reads, about.
ARCHIVES_EACH = 2


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """One gzip member: a response with its payload, or a revisit, whose block is empty and whose headers name the response."""
    whole = digest(payload)
    block = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", "<urn:page:%s>" % ("" if page_id is None else page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{whole}"),
        ("WARC-Block-Digest", f"sha1:{whole if refers_to is None else digest(b'')}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(1, ("WARC-Target-URI", _line(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level, mtime=0)


def members(pieces: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """For each gzip member of the stream, an iterator of its inflated bytes, which must be used up before the next."""
    source, rest = iter(pieces), b""

    def more() -> bool:
        nonlocal rest
        while not rest:
            piece = next(source, None)
            if piece is None:
                return False
            rest = bytes(piece)
        return True

    while more():
        unzip = zlib.decompressobj(wbits=31)

        def inflated(unzip=unzip):
            nonlocal rest
            while not unzip.eof:
                if not more():
                    raise WarcError("the archive ends inside a record")
                try:
                    out = unzip.decompress(rest, 1 << 16)
                except zlib.error as e:
                    raise WarcError(f"broken gzip member: {e}") from None
                rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
                if out:
                    yield out

        yield inflated()


def read_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record in turn; WarcError where framing or a digest is wrong."""
    for stream in members(pieces):
        buffer = bytearray()
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(stream, None)
            if piece is None:
                raise WarcError("a record without end of headers")
            buffer += piece
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        parts, have = [bytes(buffer[end + 4 :])], len(buffer) - end - 4
        for piece in stream:
            parts.append(piece)
            have += len(piece)
        if have != size + 4:
            raise WarcError(f"content length {size}, but {have - 4} bytes")
        body = b"".join(parts)
        if body[size:] != b"\r\n\r\n":
            raise WarcError("no end of record")
        block = body[:size]
        if headers["warc-block-digest"] != f"sha1:{digest(block)}":
            raise WarcError("block digest differs")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{digest(block)}":
            raise WarcError("payload digest differs")
        yield headers, block


def write_archives(pages: DataFrame, min_bytes: int = 0, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives as a table (archive, piece, data) in the shared folder; the pieces of an archive, in order, are one file.

    A record per row of (page_id, url, html), payload the html in UTF-8 (null: empty). Of rows with equal payloads of at
    least `min_bytes` bytes, the smallest page_id is the response and others are revisits of it; rows that repeat that
    page_id are responses too, and so are all rows when no row of the payload has an id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    key = rows.where(F.length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("sha1"))
    # Only payloads that occur more than once, as a plain table: its join can then split a payload with very many rows.
    firsts = key.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    firsts = written(firsts, "firsts")
    known = rows.withColumn("sha1", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    known = known.join(firsts, "sha1", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    known = known.select("page_id", "url", "payload", refers.alias("refers_to"), F.spark_partition_id().alias("task"))

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece, size, buffer, task = 0, 0, 0, bytearray(), 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([piece], pa.int32()), pa.array([bytes(buffer)], pa.binary())], ["archive", "piece", "data"])

        for ids, urls, payloads, refs, tasks in batches(batches_in, "page_id", "url", "payload", "refers_to", "task"):
            task = tasks[0].as_py()
            for page_id, url, payload, ref in zip(ids, urls, payloads, refs, strict=True):
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), ref.as_py(), level)
                buffer += data
                size += len(data)
                if len(buffer) >= PIECE_BYTES or size >= archive_bytes:
                    yield row()
                    piece += 1
                    buffer.clear()
                if size >= archive_bytes:
                    number, piece, size = number + 1, 0, 0
        if buffer:
            yield row()

    return written(known.mapInArrow(run, "archive long, piece int, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) per record; archives are read whole, in order."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        rows, ahead = ((a.as_py(), d.as_py()) for x, y in batches(batches_in, "archive", "data") for a, d in zip(x, y, strict=True)), []

        def archive(first):
            yield first[1]
            for a, d in rows:
                if a != first[0]:
                    ahead.append((a, d))
                    return
                yield d

        def number(uri):
            digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        out, size = [], 0
        while (first := ahead.pop() if ahead else next(rows, None)) is not None:
            for h, block in read_records(archive(first)):
                out.append((number(h["warc-record-id"]), h.get("warc-target-uri"), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")), block))
                size += len(block)
                if size > 4 << 20 or len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    # An archive has a bounded size, so partitions are counted by archives and grow with the data.
    some = archives.select("archive").distinct().count() // ARCHIVES_EACH
    parts = max(1, some, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = archives.repartition(parts, "archive").sortWithinPartitions("archive", "piece")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of `pages` and reads them back; an empty table gives an empty result, further columns are ignored."""
    return read_archives(write_archives(pages, min_bytes))


SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
firsts AS (SELECT body, min(page_id) AS first FROM bodies GROUP BY body),
bits AS (
  SELECT page_id, octet_length(bodies.body) AS payload_bytes, first,
         (SELECT string_agg(lpad(bin(CAST('0x' || substr(sha1(bodies.body), 2 * k - 1, 2) AS INTEGER)), 8, '0'), '' ORDER BY k) FROM range(1, 21) t(k)) AS bits
  FROM bodies JOIN firsts ON bodies.body = firsts.body)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST('0b' || substr(bits, 5 * k + 1, 5) AS INTEGER) + 1, 1), '' ORDER BY k) FROM range(0, 32) t(k)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
