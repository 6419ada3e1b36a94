"""Token ids in files of Simple-8b words.

A 64-bit word holds a 4-bit selector and as many ids of one width as fit in the other 60 bits. An
id too wide for its word is escaped: the word holds the width's highest value in its place, and
the id follows in the frame's list of escapes. Ids are packed in blocks of ``BLOCK``; a frame
lists for each block where its words and escapes begin, so blocks are decoded independently and
all at once in numpy.

A file is a run of frames, each followed by one line feed, written by Spark's text writer to any
file system that Spark knows. A frame holds whole documents in ascending order of doc_id, and says
which task wrote it and as its which frame; that, and no file name, is their order.

Scale: one range shuffle by doc_id; a task streams its sorted documents and holds one frame at a
time. Where a frame begins in the sequence of all ids is a running sum over one row per task, and
over the frames of each task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulon.llm import _bpe
from tabulon.llm._store import map_arrow, saved

#: Selector: (ids in a word, bits of each). Selector 14 holds anything.
LAYOUTS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
#: Widths below this many bits keep their highest value as the escape.
ESCAPED_BELOW = 20
MOST_ESCAPES = 3
#: Selectors below this one are for runs of very small ids, which few blocks have.
NARROW = 9
BLOCK = 256
FRAME_IDS = 1 << 20
FRAMES_PER_FILE = 32
MAGIC = b"S8B2"
_HEADER = struct.Struct("<4sIIIQIIIQ")


def _limit(bits: int) -> int:
    return (1 << bits) - (bits < ESCAPED_BELOW)


def _spare(sel: int) -> int:
    """Escapes that a word may have."""
    return min(MOST_ESCAPES, LAYOUTS[sel][0] // 2) if LAYOUTS[sel][1] < ESCAPED_BELOW else 0


def _fitting(ids: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """(wide selectors, narrow selectors, blocks) that some full word of these ids could have: the
    narrow ones only in those blocks. Of the widest ones only the first that holds all is needed.
    Words at the end of a block that hold fewer ids than their selector says gain nothing from another one."""
    most = int(ids.max())
    widest = next(s for s in (12, 13, 14) if s == 14 or most < _limit(LAYOUTS[s][1]))
    wide, narrow, blocks, at = [widest], [], np.zeros(-(-len(ids) // BLOCK), dtype=bool), np.arange(len(ids), dtype=np.int32)
    for sel in range(widest - 1, 0, -1):
        limit = np.uint32(_limit(LAYOUTS[sel][1]))
        at = at[ids[at] < limit] if len(at) < len(ids) else np.flatnonzero(ids < limit).astype(np.int32)
        count, apart = LAYOUTS[sel][0], LAYOUTS[sel][0] - _spare(sel) - 1  # so many that fit come after the first one in a word
        if len(at) <= apart:
            continue
        if sel >= NARROW:
            wide.append(sel)
        elif len(found := at[: len(at) - apart][at[apart:] - at[: len(at) - apart] < count]):
            narrow.append(sel)
            blocks[found // BLOCK] = True
    return wide, narrow, blocks


def _chosen(ids: np.ndarray, selectors: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """At the place of the first id of each word its selector, and how many ids it holds; 0 elsewhere."""
    n = len(ids)
    tried = np.array(selectors, dtype=np.uint8)
    wide = np.zeros((len(tried), n + 1), dtype=np.int32)  # how many of the ids before are too wide for a layout
    for k, sel in enumerate(selectors[1:], 1):
        np.cumsum(ids >= np.uint32(_limit(LAYOUTS[sel][1])), out=wide[k, 1:])
    count = np.array([LAYOUTS[s][0] for s in selectors])[:, None]
    spare = np.array([_spare(s) for s in selectors])[:, None]
    row = np.arange(len(tried))[:, None] * (n + 1)
    flat = wide.ravel()
    starts = np.arange(0, n, BLOCK)
    here, stop = starts, np.minimum(starts + BLOCK, n)
    chosen, size = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64)
    while len(here):  # every block takes its next word at once
        held = np.minimum(count, stop - here)
        bad = flat[row + (here + held)] - flat[row + here]
        worth = np.where(bad <= spare, held / (8 + 4 * bad), 0)  # ids by byte
        best = worth.argmax(axis=0)
        took = held[best, np.arange(len(here))]
        chosen[here], size[here] = tried[best], took
        here = here + took
        going = here < stop
        here, stop = here[going], stop[going]
    return chosen, size


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each block, first escape of each block); the last two end with the totals."""
    n = len(ids)
    if not n:
        zero = np.zeros(1, np.uint32)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), zero, zero
    ids = ids.astype(np.uint32, copy=False)
    wide, narrow, blocks = _fitting(ids)
    if blocks.any():  # blocks are packed apart from each other, so those with narrow words can be taken together
        chosen, size = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64)
        of = np.repeat(blocks, BLOCK)[:n]
        for own, selectors in ((of, wide + narrow), (~of, wide)):
            chosen[own], size[own] = _chosen(ids[own], selectors)
    else:
        chosen, size = _chosen(ids, wide)
    n_blocks = len(blocks)
    first = np.flatnonzero(chosen)
    sels, sizes = chosen[first], size[first]
    bits = np.array([0, *(LAYOUTS[s][1] for s in range(1, 15))], dtype=np.uint8)[sels]
    w = np.repeat(bits, sizes)
    slot = np.arange(n) - np.repeat(first, sizes)
    limit = np.array([0, *(_limit(LAYOUTS[s][1]) for s in range(1, 15))], dtype=np.uint64)[sels]
    escape = ids >= np.repeat(limit, sizes)
    held = ids.astype(np.uint64)
    at = np.flatnonzero(escape)
    held[at] = (np.uint64(1) << w[at].astype(np.uint64)) - np.uint64(1)
    words = np.bitwise_or.reduceat(held << (slot * w + 4).astype(np.uint64), first) | sels
    starts = np.arange(n_blocks) * BLOCK
    word_at = np.append(np.searchsorted(first, starts), len(first)).astype(np.uint32)
    return words, ids[at], word_at, np.append(np.searchsorted(at, starts), len(at)).astype(np.uint32)


def frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, part: int = 0, nth: int = 0) -> bytes:
    """The bytes of one frame, the nth of a task."""
    words, escapes, word_at, escape_at = pack(ids)
    body = b"".join(
        x.tobytes()
        for x in (
            np.array([d is not None for d in doc_ids], dtype=np.uint8),
            np.array([d or 0 for d in doc_ids], dtype="<i8"),
            lengths.astype("<u8"),
            word_at.astype("<u4"),
            escape_at.astype("<u4"),
            words.astype("<u8"),
            escapes.astype("<u4"),
        )
    )
    return _HEADER.pack(MAGIC, part, nth, len(doc_ids), len(ids), len(word_at) - 1, len(words), len(escapes), len(body)) + body


def frames(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, int, int]]:
    """(doc ids, lengths, ids, task, number in the task) of each frame of a file."""
    at = 0
    while at < len(data):
        magic, part, nth, n_docs, n_ids, n_blocks, n_words, n_escapes, size = _HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += _HEADER.size
        parts, p = [], at
        for kind, k in (("u1", n_docs), ("<i8", n_docs), ("<u8", n_docs), ("<u4", n_blocks + 1), ("<u4", n_blocks + 1), ("<u8", n_words), ("<u4", n_escapes)):
            parts.append(np.frombuffer(data, dtype=kind, count=k, offset=p))
            p += parts[-1].nbytes
        there, doc_ids, lengths, word_at, escape_at, words, escapes = parts
        yield [int(d) if ok else None for ok, d in zip(there, doc_ids, strict=True)], lengths.astype(np.int64), decode_blocks(words, escapes, word_at, escape_at, n_ids), part, nth
        at += size + 1


def decode_blocks(words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, escape_at: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all of them by default), found by the block offsets."""
    last = len(word_at) - 1 if last is None else last
    a, b = int(word_at[first]), int(word_at[last])
    own = words[a:b]
    sels = (own & np.uint64(15)).astype(np.int64)
    size = np.array([0, *(LAYOUTS[s][0] for s in range(1, 15))])[sels]
    begins = word_at[first:last].astype(np.int64) - a
    if len(own):  # a block's last word may hold fewer ids than its selector says
        full = np.minimum(BLOCK, n - np.arange(first, last) * BLOCK)
        tails = np.append(begins[1:], len(own)) - 1
        size[tails] -= np.add.reduceat(size, begins) - full
    total = int(size.sum())
    place = np.cumsum(size) - size
    out, special = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=bool)
    for sel in np.unique(sels):
        count, bits = LAYOUTS[int(sel)]
        mine = np.flatnonzero(sels == sel)
        slot = np.arange(count)
        grid = (own[mine][:, None] >> (np.uint64(4) + slot.astype(np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        valid = slot < size[mine][:, None]
        to = (place[mine][:, None] + slot)[valid]
        out[to] = grid[valid]
        if bits < ESCAPED_BELOW:
            special[to] = grid[valid] == np.uint64((1 << bits) - 1)
    out[special] = escapes[int(escape_at[first]) : int(escape_at[last])]
    return out.astype(np.uint32)


def _encode(path: str, end_id: int, frame_ids: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(path, added)
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, nth, part = 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, ids, held, nth
            data = frame(docs, np.concatenate(lengths), np.concatenate(ids), part, nth)
            docs, lengths, ids, held, nth = [], [], [], 0, nth + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["frame"])

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _bpe.portions(texts):
                got, sizes = enc.encode(texts[lo:hi])
                ended = np.insert(got, np.cumsum(sizes), np.uint32(end_id))
                docs += own[lo:hi]
                lengths.append(sizes + 1)
                ids.append(ended)
                held += len(ended)
                if held >= frame_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, to: str, path: str, end_id: int = 2, frame_ids: int = FRAME_IDS, added: bool = False) -> None:
    """Write the ids of every text, each with the end id, in ascending order of doc_id.

    Null texts count as empty; null ids come first; rows that repeat a doc_id are separate
    documents, in the order of their texts. Other columns aren't read. With ``added``, the string
    of an added token in a text gets its id, as by the library's default; else it is ordinary text.
    The file format holds whole numbers as ids, so a doc_id of another type is an error at once.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = map_arrow(ordered, _encode(path, end_id, frame_ids, added), "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES_PER_FILE).text(to)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for doc_ids, lengths, ids, part, nth in frames(content.as_py()):
                n, ends = len(doc_ids), np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(np.full(n, part)), pa.array(np.full(n, nth)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "nth", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in the order of tasks and their frames.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = saved(map_arrow(files, _decode, "part long, nth long, doc_id long, at long, n_tokens long, ids_crc32 long"), "op10-read")
    frames_ = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("held"))
    parts = frames_.groupBy("part").agg(F.sum("held").alias("held"))

    def before(w: Window) -> Column:
        return F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = parts.select("part", before(Window.orderBy("part")).alias("before"))
    starts = frames_.select("part", "nth", before(Window.partitionBy("part").orderBy("nth")).alias("within")).join(parts, "part")
    out = rows.join(starts, ["part", "nth"])
    return out.select("doc_id", (F.col("before") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
