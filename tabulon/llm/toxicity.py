"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into two embedding tables and embedded by the sum; filters of several widths run
over the words and are pooled by their maximum over the whole text; a logistic layer follows.
The tables start from how often hashed words occur in toxic and in other texts, and everything
is trained with Adam. The score is calibrated on a fold of the training rows that the weights
haven't seen; so is a threshold for each language, for those who decide by language.

Scale: the model is fitted on a bounded sample (``PER_CLASS`` rows a class, of texts of at most
``MAX_BYTES`` bytes, chosen by a hash of the id), whose ids are broadcast; scoring is a map over
whole texts, with a model of a few MB and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import _words
from tabulon.llm._bpe import portions
from tabulon.llm._store import give_back, map_arrow

#: Bounds of the training sample: rows of each class, and bytes of a text.
PER_CLASS = 3000
MAX_BYTES = 32_000
BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
#: Rows of a language in the calibration fold below which the common threshold holds.
MIN_LANG_ROWS = 40
#: A language's threshold leaves one half only for fewer errors than this share of its rows.
SPARE = 0.02
HELD_OUT = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; the rows at 0 are held out of training. Null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT)), F.lit(0))


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    return [w.hashes for w in _words.words([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=True, between=_words.PUNCTUATED)]


def _buckets(h: np.ndarray) -> np.ndarray:
    return np.stack(((h & np.uint64(BUCKETS - 1)), (h >> np.uint64(40)) & np.uint64(BUCKETS - 1))).astype(np.int64)


@dataclass
class Model:
    """Weights of the classifier, its calibration, and the thresholds by language."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    training: bool = False

    def pooled(self, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pooled activations, where each was reached) of texts whose words' buckets follow each other."""
        x = self.tables[0][b[0]] + self.tables[1][b[1]]
        n, ends = len(sizes), np.cumsum(sizes)
        starts = ends - sizes
        value = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
        where = np.full(value.shape, -1, dtype=np.int64)
        for k, width in enumerate(WIDTHS):
            m = len(x) - width + 1
            if m <= 0:
                continue
            act = sum(x[j : j + m] @ self.filters[k][j] for j in range(width)) + self.biases[k]
            has = np.flatnonzero(sizes >= width)
            if not len(has):
                continue
            inside = np.repeat(ends, sizes)[:m] - np.arange(m) >= width
            act[~inside] = -np.inf
            top = np.maximum.reduceat(act, starts[has], axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            value[has, cols] = np.maximum(top, 0)
            if self.training:
                for d in has:
                    at = act[starts[d] : ends[d] - width + 1].argmax(axis=0)
                    where[d, cols] = np.where(value[d, cols] > 0, starts[d] + at, -1)
        return value, where

    def logits(self, texts: list[str | None]) -> np.ndarray:
        hs = _hashes(texts)
        sizes = np.array([len(h) for h in hs], dtype=np.int64)
        value, _ = self.pooled(_buckets(np.concatenate(hs) if hs else np.zeros(0, np.uint64)), sizes)
        return value @ self.out[:-1] + self.out[-1]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))


def _init(hs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Model:
    tables = []
    for t in range(2):
        seen = np.zeros((2, BUCKETS))
        for h, label in zip(hs, y, strict=True):
            seen[int(label), np.unique(_buckets(h)[t])] += 1
        n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        odds[seen.sum(axis=0) < 3] = 0
        e = rng.normal(0, 0.05, (BUCKETS, DIM))
        e[:, 0] = np.clip(odds, -3, 3) / 2
        tables.append(e.astype(np.float32))
    filters, biases = [], []
    for width in WIDTHS:
        f = rng.normal(0, 0.1, (width, DIM, FILTERS))
        f[0, 0] += 1.0
        filters.append(f.astype(np.float32))
        biases.append(np.full(FILTERS, -1.0, dtype=np.float32))
    out = np.append(np.full(len(WIDTHS) * FILTERS, 0.1), -1.0).astype(np.float32)
    return Model(tables, filters, biases, out)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, key: str, w: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(key, (np.zeros_like(w), np.zeros_like(w)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        w[at] -= self.rate * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)


def _epoch(model: Model, adam: _Adam, hs: list[np.ndarray], y: np.ndarray, order: np.ndarray, batch: int = 32) -> None:
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    for lo in range(0, len(order), batch):
        rows = order[lo : lo + batch]
        b = _buckets(np.concatenate([hs[i] for i in rows]))
        value, where = model.pooled(b, np.array([len(hs[i]) for i in rows]))
        p = 1 / (1 + np.exp(-np.clip(value @ model.out[:-1] + model.out[-1], -40, 40)))
        err = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
        adam.t += 1
        grad_value = err[:, None] * model.out[:-1]
        adam.step("out", model.out, np.append(err @ value, err.sum()).astype(np.float32) + 1e-4 * model.out)
        grads = []
        for k, width in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            w, g = where[:, cols], grad_value[:, cols]
            doc, f = np.nonzero(w >= 0)
            at, val = w[doc, f], g[doc, f]
            grad_filter = np.zeros_like(model.filters[k])
            for j in range(width):
                words = b[:, at + j]
                x = model.tables[0][words[0]] + model.tables[1][words[1]]
                np.add.at(grad_filter[j].T, f, val[:, None] * x)
                grads.append((words, val[:, None] * model.filters[k][j][:, f].T))
            adam.step(f"f{k}", model.filters[k], grad_filter + 1e-4 * model.filters[k])
            adam.step(f"b{k}", model.biases[k], np.bincount(f, val, FILTERS).astype(np.float32))
        for t in range(2):
            rows_t = np.concatenate([w[t] for w, _ in grads])
            if not len(rows_t):
                continue
            uniq, back = np.unique(rows_t, return_inverse=True)
            total = np.zeros((len(uniq), DIM), dtype=np.float32)
            np.add.at(total, back, np.concatenate([g for _, g in grads]))
            adam.step(f"t{t}", model.tables[t], total, uniq)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    return max(a, 1e-3), b


def _best_threshold(score: np.ndarray, y: np.ndarray, spare: float = 0.0) -> float:
    """Of the cuts with the fewest errors, or up to that share of the rows more, the one nearest to one half."""
    cuts = np.unique(np.concatenate(([0.0], score, [1.0])))
    mids = (cuts[1:] + cuts[:-1]) / 2
    errors = np.array([((score >= c) != y).sum() for c in mids])
    good = mids[errors <= errors.min() + spare * len(y)]
    if good.min() <= 0.5 <= good.max() and ((score >= 0.5) != y).sum() <= errors.min() + spare * len(y):
        return 0.5
    return float(good[np.argmin(abs(good - 0.5))])


def train(texts: list[str], y: np.ndarray, langs: list[str | None], seed: int = 0) -> Model:
    """A model from texts and labels of 0 and 1. With one class only, its share is every score."""
    rng = np.random.default_rng(seed)
    hs = _hashes(texts)
    y = y.astype(np.float64)
    tune = np.zeros(len(y), dtype=bool)
    tune[rng.permutation(len(y))[: len(y) // 5]] = True
    fit = np.flatnonzero(~tune & (np.array([len(h) for h in hs]) > 0)) if len(y) else np.zeros(0, np.int64)
    if not len(fit) or y[fit].min() == y[fit].max():
        share = float(y.mean()) if len(y) else 0.0
        empty = _init([], np.zeros(0), rng)
        empty.out[:] = 0
        empty.shift = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return empty
    model = _init([hs[i] for i in fit], y[fit], rng)
    model.training, adam = True, _Adam(0.01)
    for e in range(EPOCHS):
        adam.rate = 0.01 * (1 - e / EPOCHS)
        _epoch(model, adam, [hs[i] for i in fit], y[fit], rng.permutation(len(fit)))
    model.training = False
    if y[tune].sum() < 10:
        tune[:] = True  # too few to calibrate by: use all
    rows = np.flatnonzero(tune)
    z = np.concatenate([model.logits([texts[i] for i in rows[lo : lo + 64]]) for lo in range(0, len(rows), 64)])
    model.slope, model.shift = _platt(z, y[rows])
    score = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))
    # Move the cut with the fewest errors to one half.
    cut = np.clip(_best_threshold(score, y[rows]), 1e-6, 1 - 1e-6)
    model.shift -= float(np.log(cut / (1 - cut)))
    score = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40)))
    own = np.array([langs[i] or "" for i in rows])
    for lang in np.unique(own):
        mine = own == lang
        if lang and mine.sum() >= MIN_LANG_ROWS and 0 < y[rows][mine].sum() < mine.sum():
            model.thresholds[str(lang)] = _best_threshold(score[mine], y[rows][mine], SPARE)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows outside the held-out fold.

    Labels that are null or neither 0 nor 1, and labels of one doc_id that disagree, are left out.
    """
    rows = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most")
    pick = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for k in (0, 1)]
    sample = pick[0].unionByName(pick[1]).select(F.col("doc_id").alias("_id"), "toxic")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    texts = docs.filter(F.octet_length("text") <= MAX_BYTES).select("doc_id", "text", lang)
    got = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id", "text"]).orderBy("doc_id").select("text", "toxic", "lang").collect()
    model = train([r.text for r in got], np.array([r.toxic for r in got]), [r.lang for r in got])
    del got
    give_back()  # the sample and the optimiser's state
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, cut = _batch_scores(model, batch), _cuts(model, batch)
            cols = [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(cut, pa.float64()), pa.array(score >= cut)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "threshold", "flagged"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, threshold, flagged.

    The score depends on the text alone. ``predicted`` is score >= 0.5; ``flagged`` is score >=
    ``threshold``, the one calibrated for the row's language (0.5 where that is null or unknown).
    Null and empty texts get the score of a text without words. Repeated rows are scored alike;
    null ids pass through and count as held out; an empty table gives an empty result.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    made = map_arrow(docs.select("doc_id", "text", lang), _score(model), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, threshold double, flagged boolean")
    return made.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "threshold", "flagged")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't flag by language."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, _keep(model), schema)


def _cuts(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    """Each row's threshold."""
    langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
    return np.array([model.thresholds.get(x or "", 0.5) for x in langs], dtype=np.float64)


def _batch_scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column("text").to_pylist()
    got = [model.scores(texts[lo:hi]) for lo, hi in portions([t or "" for t in texts])]
    return np.concatenate(got) if got else np.zeros(0)


def _keep(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(model, batch) < _cuts(model, batch)))

    return run
