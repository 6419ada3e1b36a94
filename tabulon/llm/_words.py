"""Words, word hashes and shingles of whole texts, in numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text, which
is the same as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points. Texts are hashed in chunks
of about ``CHUNK`` bytes cut between words, so that a text of any length needs bounded scratch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_GRAM_BASE = 0xD6E8FEB86659FD93

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte but letters and digits.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed & _MASK))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n; the base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = out[0], out[1]
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` values by differences of a polynomial prefix sum."""
    m = len(values)
    if m < n:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(_GRAM_BASE, m)
    total = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[n:] - total[: m - n + 1]) * down[: m - n + 1] + np.uint64(n))


def _hash_chunk(buf: np.ndarray, table: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~between[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(_BYTE_BASE, len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(table[buf] * up, out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts] if len(starts) else np.empty(0, dtype=np.uint64)
    return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)), starts, ends


def _cuts(buf: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """Chunks of about CHUNK bytes that end between words."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n and not between[buf[hi]]:
            gap = np.flatnonzero(between[buf[hi : hi + CHUNK]])
            hi = min(n, hi + (int(gap[0]) if len(gap) else CHUNK))
        yield lo, hi
        lo = hi


class Words:
    """The words of one text: their hashes, and their places in the UTF-8 bytes."""

    __slots__ = ("buf", "ends", "hashes", "starts")

    def __init__(self, buf: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf, self.hashes, self.starts, self.ends = buf, hashes, starts, ends

    def __len__(self) -> int:
        return len(self.hashes)


def _one(buf: np.ndarray, table: np.ndarray, between: np.ndarray) -> Words:
    parts = []
    for lo, hi in _cuts(buf, between):
        h, s, e = _hash_chunk(buf[lo:hi], table, between)
        parts.append((h, s + lo, e + lo))
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return Words(buf, np.empty(0, dtype=np.uint64), none, none)
    if len(parts) == 1:
        return Words(buf, *parts[0])
    return Words(buf, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def words(texts: list[bytes | None], lower: bool = False, seed: int = 0, between: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of each text (null: none), which are runs of bytes not in ``between``, a table
    that holds the space. Short texts are hashed together, long ones alone."""
    table = _table(seed)
    if lower:
        table = table[_LOWER]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size := size + len(texts[j] or b"") + 1) <= CHUNK:
            j += 1
        if j <= i + 1:
            yield _one(np.frombuffer(texts[i] or b"", dtype=np.uint8), table, between)
            i += 1
            continue
        group = [t or b"" for t in texts[i:j]]
        buf = np.frombuffer(b" ".join(group), dtype=np.uint8)
        hashes, starts, ends = _hash_chunk(buf, table, between)
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in group])))
        cut = np.searchsorted(starts, at)
        for k in range(len(group)):
            lo, hi, off = cut[k], cut[k + 1], at[k]
            yield Words(buf[off : at[k + 1] - 1], hashes[lo:hi], starts[lo:hi] - off, ends[lo:hi] - off)
        i = j


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The set of ``n``-word shingles as sorted hashes; fewer words give the sequence as one."""
    if not len(hashes):
        return hashes
    return np.unique(rolling(hashes, min(n, len(hashes))))


def parts(batch: pa.RecordBatch, size: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about ``size`` bytes together, to bound what is held at once."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0), dtype=np.int64))
    lo = 0
    while lo < len(ends):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
