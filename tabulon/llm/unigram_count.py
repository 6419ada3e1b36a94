"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick enumerates the pieces that match in a word; a dynamic program carries the best score
and its number of pieces, by the tokenizer's own rules for ties (see ``_lattice``). Words are
segmented alone, so each distinct word is counted once while it is in a bounded cache, and a
text's count is the sum over its words. Rows are computed alone: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulon.llm._bpe import portions
from tabulon.llm._lattice import Lattice, lattice
from tabulon.llm._store import map_arrow

#: Distinct words, and as many parts of words, that a worker remembers.
CACHE = 500_000


class WordCounts:
    """Counts and scores of words, remembered."""

    def __init__(self, lat: Lattice, cache: int = CACHE):
        self.lattice, self.cache = lat, cache
        self.known: dict[str, tuple[int, float]] = {}
        self.parts: dict[str, tuple[int, float]] = {}

    def _word(self, word: str) -> tuple[int, float]:
        pieces, score = 0, 0.0
        for part in self.lattice.cut(word):
            got = self.parts.get(part)
            if got is None:
                got = self.parts[part] = self.lattice.count(part)
            pieces, score = pieces + got[0], score + got[1]
        return pieces, score

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, score) of each text."""
        per_text = [self.lattice.words(t) for t in texts]
        new = set().union(*per_text).difference(self.known)
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = set().union(*per_text)
        if len(self.parts) > self.cache:
            self.parts.clear()
        word = self._word
        self.known.update((w, word(w)) for w in new)
        get = self.known.__getitem__
        found = [list(map(get, ws)) for ws in per_text]
        return np.array([sum(c for c, _ in f) for f in found], dtype=np.int64), np.array([sum(s for _, s in f) for f in found], dtype=np.float64)


_counters: dict[str, WordCounts] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, WordCounts(lattice(path)))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = [counter.of(texts[lo:hi]) for lo, hi in portions(texts)]
            n = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            score = np.concatenate([g[1] for g in got]) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score per row of ``docs``.

    Null and empty texts have no tokens and score 0. Repeated rows are counted alike; null ids
    pass through; other columns aren't read; an empty table gives an empty result.
    """
    return map_arrow(docs.select("doc_id", "text"), _count(path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, score double")
