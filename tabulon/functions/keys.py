"""Keys of records: their byte encoding, their names, and time-ordered ids."""

from __future__ import annotations

import os
import struct
import time
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.shipping import ship

#: Tags of the key encoding.
TAG_INT, TAG_DOUBLE, TAG_TEXT, TAG_BLOB, TAG_UUID = 1, 2, 3, 4, 5


def encode_key(parts: list[object]) -> bytes:
    """A count, then a tag and a little-endian payload per part; no part may be null."""
    out = [struct.pack("<B", len(parts))]
    for p in parts:
        if p is None:
            raise ValueError("a key has no null parts")
        if isinstance(p, (bool, int)):
            out.append(struct.pack("<Bq", TAG_INT, int(p)))
        elif isinstance(p, float):
            out.append(struct.pack("<Bd", TAG_DOUBLE, p))
        elif isinstance(p, (bytes, bytearray)):
            out.append(struct.pack("<B", TAG_UUID) + bytes(p) if len(p) == 16 else struct.pack("<BI", TAG_BLOB, len(p)) + bytes(p))
        else:
            raw = str(p).encode()
            out.append(struct.pack("<BI", TAG_TEXT, len(raw)) + raw)
    return b"".join(out)


def decode_key(data: bytes) -> list[object]:
    n, at, out = data[0], 1, []
    for _ in range(n):
        tag, at = data[at], at + 1
        if tag in (TAG_INT, TAG_DOUBLE):
            out.append(struct.unpack_from("<q" if tag == TAG_INT else "<d", data, at)[0])
            at += 8
        elif tag == TAG_UUID:
            out.append(data[at : at + 16])
            at += 16
        else:
            size = struct.unpack_from("<I", data, at)[0]
            raw = data[at + 4 : at + 4 + size]
            out.append(raw.decode() if tag == TAG_TEXT else raw)
            at += 4 + size
    return out


@F.pandas_udf(T.BinaryType())
def _encoded(*parts: pd.Series) -> pd.Series:
    return pd.Series([encode_key([None if x is None or x is pd.NA else x.item() if hasattr(x, "item") else x for x in row]) for row in zip(*parts, strict=True)])


def key_bytes(*columns: Column) -> Column:
    """The byte encoding of a key. A null part is an error."""
    ship(SparkSession.active())
    return _encoded(*columns)


def record_name(entity_type: Column, key: Column) -> Column:
    """SHA-256 over the length of the type (big-endian, 64 bits), the type and the key, in hex."""
    kind = F.encode(entity_type, "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.octet_length(kind).cast("long")), 16, "0"))
    return F.sha2(F.concat(size, kind, key), 256)


def uuid7(at_ms: int | None = None) -> bytes:
    """A time-ordered id: 48 bits of Unix milliseconds, then random bits; bytes sort by time."""
    ms = time.time_ns() // 1_000_000 if at_ms is None else at_ms
    raw = bytearray(ms.to_bytes(6, "big") + os.urandom(10))
    raw[6] = 0x70 | raw[6] & 0x0F
    raw[8] = 0x80 | raw[8] & 0x3F
    return bytes(raw)


def uuid7_time(raw: bytes) -> datetime:
    return datetime.fromtimestamp(int.from_bytes(raw[:6], "big") / 1000, timezone.utc)


def uuid7_timestamp(c: Column) -> Column:
    """The time of a time-ordered id in a binary column."""
    return F.timestamp_millis(F.conv(F.substring(F.hex(c), 1, 12), 16, 10).cast("long"))


def from_unix_seconds(c: Column) -> Column:
    """A timestamp from seconds with a fraction, to the microsecond."""
    return F.timestamp_micros(F.round(c * 1_000_000).cast("long"))


def to_unix_seconds(c: Column) -> Column:
    return F.unix_micros(c) / 1_000_000
