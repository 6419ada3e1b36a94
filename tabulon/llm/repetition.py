"""Repetition rules: how much of a text lies in repeated n-grams and repeated lines.

For several lengths n, every window of n words has a rolling hash; windows whose hash was seen
earlier in the text are repeats, and the characters of the words that they cover are measured.
Windows are told apart by 64 bits of hash, and those that agree also by the 64 bits of each of their
words, not by the words' bytes. Runs of repeated n-grams only exist where shorter ones do, so most
texts stop after the shortest length.

Each row is computed alone, in batches of Arrow rows: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm import _words
from tabulon.llm._store import map_arrow

#: n-gram length and the largest share of a text's word characters in repeated n-grams of it; one
#: line said twice in a short text stays below.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.22, 8: 0.20, 9: 0.18, 10: 0.16}
#: Largest share of characters in lines that equal an earlier one, and of such lines.
LINE_CHARS_LIMIT = 0.25
LINES_LIMIT = 0.50
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
BASE_WINDOW = 8
BASE_SHARE = 30

_CODE_POINT = np.ones(256, dtype=np.uint8)
_CODE_POINT[0x80:0xC0] = 0
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_windows(w: _words.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words that equal an earlier window, and of all that equal another."""
    h = _words.rolling(w.hashes, n)
    none = np.empty(0, dtype=np.int64)
    if len(h) < 2:
        return none, none
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return none, none
    first = order[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(h)), 0))]
    later = np.concatenate(([False], same))
    starts, firsts = order[later], first[later]
    equal = np.ones(len(starts), dtype=bool)
    for k in range(n):
        equal &= w.hashes[starts + k] == w.hashes[firsts + k]
    starts, firsts = starts[equal], firsts[equal]
    return starts, np.union1d(starts, firsts)


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in windows of n words that start there."""
    edge = np.zeros(words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes, w: _words.Words) -> dict:
    """All measures of one text in UTF-8."""
    buf = np.frombuffer(text, dtype=np.uint8)
    points = np.concatenate(([0], np.cumsum(_CODE_POINT[buf], dtype=np.int32))) if len(buf) else np.zeros(1, np.int32)
    chars = (points[w.ends] - points[w.starts]).astype(np.int64)
    total = int(chars.sum())
    out = {"n_words": len(w), "word_chars": total, "n_symbols": int(np.count_nonzero(_SYMBOL[buf]))}
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    seen: set[bytes] = set()
    dup, dup_chars, line_chars = 0, 0, 0
    for x in lines:
        size = len(x.decode("utf-8", "replace"))
        line_chars += size
        if x in seen:
            dup += 1
            dup_chars += size
        seen.add(x)
    out |= {"n_dup_lines": dup, "dup_line_char_frac": dup_chars / line_chars if line_chars else 0.0, "dup_line_frac": dup / len(lines) if lines else 0.0}
    found = True
    for n in sorted({*NGRAM_LIMITS, BASE_WINDOW}):
        later, every = repeated_windows(w, n) if found else (np.empty(0, np.int64),) * 2
        found = len(later) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = int(_covered(every, n, len(w)).sum()) if found else 0
        if n in NGRAM_LIMITS:
            out[f"dup_{n}gram_char_frac"] = int(chars[_covered(later, n, len(w))].sum()) / total if found and total else 0.0
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept) of one text's measures."""
    base_failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > BASE_SHARE * m["n_words"]
    good = m["dup_line_char_frac"] <= LINE_CHARS_LIMIT and m["dup_line_frac"] <= LINES_LIMIT and all(m[f"dup_{n}gram_char_frac"] <= x for n, x in NGRAM_LIMITS.items())
    return base_failed, good and not base_failed


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHARES = ["dup_line_char_frac", "dup_line_frac", *(f"dup_{n}gram_char_frac" for n in NGRAM_LIMITS)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _words.parts(whole)):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = [measure(t or b"", w) for t, w in zip(texts, _words.words(texts), strict=True)]
        kept = [verdict(m) for m in rows]
        cols = [batch.column("doc_id"), *(pa.array([m[k] for m in rows], pa.int64()) for k in _LONGS)]
        cols += [pa.array([k[i] for k in kept], pa.bool_()) for i in (0, 1)]
        cols += [pa.array([m[k] for m in rows], pa.float64()) for k in _SHARES]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", *_LONGS, "base_failed", "kept", *_SHARES])


def repetition(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed and kept.

    A null or empty text, or one of white space only, has no words: it fails the base rule. Lines
    without a word don't count as lines. The first of equal lines and of equal n-grams is no
    repeat, except in n_repeat_words, which counts the words of all of them. Repeated rows are
    measured alike; null ids pass through; other columns aren't read; an empty table gives an
    empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *(f"{k} long" for k in _LONGS), "base_failed boolean, kept boolean", *(f"{k} double" for k in _SHARES)])
    return map_arrow(docs.select("doc_id", "text"), _run, schema)


def repetition_sql(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``repetition``."""
    every = sorted({*NGRAM_LIMITS, BASE_WINDOW})
    ctes = [
        rf"t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {table})",
        "w AS (SELECT id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM t)",
        "l0 AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, unnest(string_split(text, chr(10))) AS line FROM t)",
        r"l1 AS (SELECT id, length(line) AS chars, row_number() OVER (PARTITION BY id, line ORDER BY k) > 1 AS dup FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))",
        "l AS (SELECT id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars) FILTER (dup), 0) / sum(chars) AS dup_line_char_frac, count(*) FILTER (dup) / count(*) AS dup_line_frac FROM l1 GROUP BY id)",
    ]
    for n in every:
        ctes += [
            f"g{n} AS (SELECT id, unnest(range(1, len(ws) - {n - 2})) AS i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS g FROM t WHERE len(ws) >= {n})",
            f"r{n} AS (SELECT id, i, row_number() OVER (PARTITION BY id, g ORDER BY i) > 1 AS later, count(*) OVER (PARTITION BY id, g) > 1 AS again FROM g{n})",
            f"c{n} AS (SELECT id, length(word) AS chars, max(later) OVER k AS later, max(again) OVER k AS again FROM w LEFT JOIN r{n} USING (id, i) WINDOW k AS (PARTITION BY id ORDER BY i ROWS {n - 1} PRECEDING))",
            f"f{n} AS (SELECT id, coalesce(sum(chars) FILTER (later), 0) / sum(chars) AS frac, count(*) FILTER (again) AS words FROM c{n} GROUP BY id)",
        ]
    joins = " ".join(f"LEFT JOIN f{n} USING (id)" for n in every)
    shares = ", ".join(f"coalesce(f{n}.frac, 0.0) AS dup_{n}gram_char_frac" for n in NGRAM_LIMITS)
    ctes.append(
        f"m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, "
        rf"CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(f{BASE_WINDOW}.words, 0) AS n_repeat_words, "
        f"coalesce(dup_line_char_frac, 0.0) AS dup_line_char_frac, coalesce(dup_line_frac, 0.0) AS dup_line_frac, {shares} FROM t LEFT JOIN l USING (id) {joins})"
    )
    ctes.append(f"b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_SHARE} * n_words AS base_failed FROM m)")
    good = " AND ".join([f"dup_line_char_frac <= {LINE_CHARS_LIMIT}", f"dup_line_frac <= {LINES_LIMIT}", *(f"dup_{n}gram_char_frac <= {x}" for n, x in NGRAM_LIMITS.items())])
    return "WITH " + ",\n".join(ctes) + f"\nSELECT *, NOT base_failed AND {good} AS kept FROM b"
