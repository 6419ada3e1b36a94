"""WARC archives: a writer, and a reader that salvages what a damaged archive still holds.

The writer makes a record of each page, with DataFrame functions and Spark's text writer, on any
file system that Spark knows. Of pages with equal payloads one is a response, and the others are
revisit records that refer to it.

The reader checks every record: its version line, its headers, its length, what follows it, and
its digests. Where a check fails it goes on at the next version line or gzip member from which a
valid record follows, and logs the bytes between as a quarantined gap. Within a gzip member it does
the same over what the member inflates to, up to where that fails. Files are read by Spark, one row
each; the writer bounds their size: pages of a size class are written by themselves, so many to a
file that it stays below ``FILE_BYTES``, or one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm._store import map_arrow, saved

#: Fixed strings of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:tabulon:page:"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 2000
#: Bytes of payloads that a file holds at most, but for a file of one record; and the size classes of payloads.
FILE_BYTES = 64 << 20
CLASSES = (32 << 10, 256 << 10, 2 << 20, 16 << 20)
#: Bytes that are inflated at a time.
STEP = 1 << 16
#: Digests of repeated payloads up to so many are broadcast (about 50 bytes each).
BROADCAST_DIGESTS = 100_000


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 10 digits are 40 bits, which are 8 letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, to: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is
    the response. A null html is an empty payload; a null url leaves its header out, and control
    characters and spaces in one become underscores. Rows that repeat a page_id and a payload
    have the same record type. A null page_id has the id "null" and is never referred to.
    """
    p = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long"))
    key = F.sha2("payload", 256)
    repeated = p.filter(F.col("bytes") >= min_bytes).groupBy(key.alias("_key")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    repeated = saved(repeated.filter("_n > 1 and _first is not null").select("_key", "_first"), "op6-repeated")
    few = repeated.count() <= BROADCAST_DIGESTS
    p = p.withColumn("_key", F.when(F.col("bytes") >= min_bytes, key)).join(F.broadcast(repeated) if few else repeated, "_key", "left")
    again = F.coalesce(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    p = p.withColumn("_again", again).withColumn("block", F.when(F.col("_again"), head).otherwise(F.concat(head, F.col("payload"))))
    name = F.coalesce("page", F.lit("null"))
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(F.col("_again"), "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{ID_PREFIX}"),
        name,
        F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "_"), F.lit("\r\n")), F.lit("")),
        F.when(F.col("_again"), F.concat(F.lit(f"WARC-Refers-To: <{ID_PREFIX}"), F.col("_first").cast("string"), F.lit(f">\r\nWARC-Profile: {IDENTICAL}\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        base32_of_hex(F.sha1("payload")),
        F.lit("\r\nWARC-Block-Digest: sha1:"),
        base32_of_hex(F.sha1("block")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block"),
        F.lit("\r\n\r\n"),
        F.col("block"),
    )
    upper = F.lit(None).cast("long")
    for size in reversed(CLASSES):
        upper = F.when(F.col("bytes") <= size, size).otherwise(upper)
    p = p.withColumn("_upper", upper)
    there = pages.select(F.octet_length("html").cast("long").alias("bytes")).select(F.coalesce("bytes", F.lit(0)).alias("bytes")).select(upper.alias("_upper")).distinct()
    out = p.select("_upper", record.alias("value"))
    for c in [r[0] for r in there.collect()] or [CLASSES[0]]:  # a few classes
        most = min(records_per_file, max(1, FILE_BYTES // c)) if c else 1
        own = out.filter(F.col("_upper").eqNullSafe(F.lit(c))).select("value")
        own.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(to)


class Record(NamedTuple):
    """A valid record, or with a ``reason`` a quarantined gap."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes
    reason: str = ""


_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_NEXT = re.compile(rb"WARC/\d+\.\d+\r\n|\x1f\x8b\x08")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _agrees(stated: str, data: bytes) -> bool:
    """Whether a digest, in base32 or hexadecimal of either case, is that of the data. Other algorithms than SHA-1 aren't checked."""
    kind, _, value = stated.partition(":")
    if kind.strip().lower() != "sha1":
        return True
    digest = hashlib.sha1(data)
    return value.strip().lower() in (base64.b32encode(digest.digest()).decode().lower(), digest.hexdigest())


def payload_of(record: Record) -> bytes:
    """The bytes after the HTTP header of a response, else the block."""
    if record.headers.get("warc-type") in ("response", "revisit") and record.block.startswith(b"HTTP/"):
        return record.block.partition(b"\r\n\r\n")[2]
    return record.block


def _plain(data: bytes, at: int) -> Record | str:
    """The record that begins at a version line, or what is wrong with it."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        return "no version line"
    headers: dict[str, str] = {}
    begin, name = line.end(), ""
    while (stop := data.find(b"\r\n", begin)) != begin:  # up to an empty line, however long a header is
        if stop < 0:
            return "headers don't end"
        if name and data[begin : begin + 1] in (b" ", b"\t"):  # the header before goes on here
            headers[name] += " " + data[begin:stop].strip().decode("utf-8", "replace")
            begin = stop + 2
            continue
        colon = data.find(b":", begin, stop)
        if colon < 0:
            return "a header without a colon"
        name = data[begin:colon].strip().lower().decode("latin-1")
        headers[name] = data[colon + 1 : stop].strip().decode("utf-8", "replace")
        begin = stop + 2
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return "no length"
    begin = stop + 2
    end = begin + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return "the block doesn't end where its length says"
    record = Record(at, end + 4, headers, data[begin:end])
    if not _agrees(headers.get("warc-block-digest", ""), record.block):
        return "the block's digest differs"
    if headers.get("warc-type") == "response" and not _agrees(headers.get("warc-payload-digest", ""), payload_of(record)):
        return "the payload's digest differs"
    return record


BREAKS_OFF = "the gzip member doesn't end"


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(what the gzip member there inflates to, where it ends, "") or, if it is damaged, (what it inflates
    to before that, where to look for the next one from, what is wrong)."""
    gz, out, view, pos = zlib.decompressobj(31), [], memoryview(data), at
    while pos < len(data):
        step, before = view[pos : pos + STEP], gz.copy()
        try:
            out.append(gz.decompress(step))
        except zlib.error as e:
            for k in range(len(step)):  # up to the damage
                try:
                    out.append(before.decompress(step[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), max(pos, at + 1), f"gzip: {e}"
        pos += len(step)
        if gz.eof:
            return b"".join(out), pos - len(gz.unused_data), ""
    return b"".join(out), len(data), BREAKS_OFF


def _member(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """(valid records and gaps of the gzip member there, at the member's bytes; where to go on; what is wrong with it).

    Of a member that breaks off, all records before that count. In one that is damaged the bytes after the
    damage, and headers, may be wrong without a sign: only records before the first one that fails
    count, with a block digest that agrees, and none if no record fails.
    """
    plain, end, wrong = _inflated(data, at)
    found = []
    for r in salvage(plain, member=True):
        why = r.reason and f"bytes {r.start} to {r.end} of what the gzip member inflates to: {r.reason}"
        found.append(r._replace(start=at, end=end, reason=why))
    bad = next((k for k, r in enumerate(found) if r.reason), None)
    if wrong and wrong != BREAKS_OFF:
        found = [r for r in found[: bad or 0] if r.headers.get("warc-block-digest")]
    elif wrong and found and found[-1].reason:
        found.pop()  # what breaks off with the member
    if all(r.reason for r in found):
        return [], end, wrong or (found[0].reason if found else "an empty gzip member")
    return found, end, wrong


def salvage(data: bytes, member: bool = False) -> Iterator[Record]:
    """All valid records of an archive, and its gaps, in order. Every byte belongs to one of them.

    Gaps within a gzip member have the bytes of the member, and say where in it they are. With
    ``member`` the data is what a gzip member inflates to.
    """
    at, gap, reason = 0, -1, ""
    begins = _VERSION_LINE if member else _NEXT
    while at < len(data):
        if not member and data[at : at + 3] == b"\x1f\x8b\x08":
            found, stop, wrong = _member(data, at)
        else:
            got = _plain(data, at)
            found, stop, wrong = ([got], got.end, "") if isinstance(got, Record) else ([], at + 1, got)
        if found:
            if 0 <= gap < at:
                yield Record(gap, at, {}, b"", reason)
            yield from found
            gap = -1
        if wrong:
            if gap < 0:
                gap, reason = stop if found else at, wrong
            following = begins.search(data, max(stop, at + 1) if found else at + 1)
            stop = following.start() if following else len(data)
        at = stop
    if 0 <= gap < len(data):
        yield Record(gap, len(data), {}, b"", reason)


_SCHEMA = "file string, start long, end long, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _row(file: str, r: Record, keep: bool) -> tuple:
    if r.reason:
        return (file, r.start, r.end, r.reason, *(None,) * 7)
    h, payload = r.headers, payload_of(r)
    size, digest = len(payload), _digest(payload)
    if h.get("warc-type") == "revisit":  # its payload is elsewhere; the headers tell its size and digest
        size = next((int(m[1]) for m in [re.search(rb"(?i)\r\nContent-Length:\s*([0-9]{1,18})", r.block)] if m), None)
        digest, payload = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    return (file, r.start, r.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, payload if keep else None)


def _read(keep: bool):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for r in salvage(content.as_py()):
                    rows.append(_row(file.as_py(), r, keep))
                    if len(rows) == 500:
                        yield table(rows)
                        rows = []
                yield table(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per valid record and per gap of the archives at ``path``, plain or gzipped by record.

    ``gap`` tells why bytes start to end are quarantined; it is null for records. The payload's
    size and digest of a response are those of the bytes found; of a revisit record, those that
    its headers state. ``payload`` is null without ``payloads``, and for revisit records. An
    archive without bytes gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, _read(payloads), _SCHEMA)
