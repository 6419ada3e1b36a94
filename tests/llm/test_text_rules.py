import random
import re
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import _words, repetition, toxicity
from compare import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\t\x0b\x1c\x85\xa0é漢") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x" * 3_000_000, "a b " * 700_000]
    for t, w in zip(texts, _words.words([t.encode() for t in texts]), strict=True):
        got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.starts[:2000], w.ends[:2000], strict=True)]
        assert got == WORD.findall(t)[:2000] and len(w) == len(WORD.findall(t))


def test_equal_words_have_equal_hashes_wherever_they_stand():
    a, b = _words.words([b"xx The end", b"end  the"], lower=True)
    assert a.hashes[1] == b.hashes[1] and a.hashes[2] == b.hashes[0] and len({*a.hashes, *b.hashes}) == 3


def brute(t):
    words = WORD.findall(t)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def brute_share(t, n):
    words, seen, hit = WORD.findall(t), set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit |= set(range(i, i + n))
        seen.add(g)
    return sum(len(words[j]) for j in hit) / max(1, sum(map(len, words)))


def odd_texts():
    rng = random.Random(2)
    out = [" ".join(rng.choice(["a", "bé", "c#", "漢字"]) for _ in range(rng.randrange(80))).replace(" a ", rng.choice([" a ", "\n", "\n\n"])) for _ in range(150)]
    line = "one line that is said again and again here"
    return [*out, "", None, " \n ", "\n".join([line] * 5), " ".join(f"w{i}" for i in range(500)), "| a | b\n| a | b"]


def test_repetition_against_brute_force(docs_of):
    texts = odd_texts()
    rows = {r.doc_id: r for r in repetition.repetition(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r, b = rows[i], brute(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, t
        for n in repetition.NGRAM_LIMITS:
            assert abs(r[f"dup_{n}gram_char_frac"] - brute_share(t or "", n)) < 1e-12, (n, t)
        base = b[0] < 20 or 100 * b[4] > 30 * b[0]
        assert r.base_failed == base and (not base or not r.kept)


def test_repetition_keeps_prose_and_drops_loops(docs_of):
    prose = " ".join(f"w{i % 97}x{i}" for i in range(300))
    loop = " ".join(["again the same few words here"] * 60)
    got = {r.doc_id: r.kept for r in repetition.repetition(docs_of([(1, prose), (2, loop), (None, prose)])).collect()}
    assert got == {1: True, 2: False, None: True}
    assert repetition.repetition(docs_of([])).count() == 0


def labelled(rng, n):
    bad = ["scum", "idiot", "vile"]
    texts, y = [], []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        y.append(int(toxic))
    return texts, np.array(y)


def test_classifier_learns_and_scores_whole_texts():
    rng = random.Random(3)
    texts, y = labelled(rng, 900)
    model = toxicity.train(texts[:600], y[:600], ["en"] * 600)
    said = model.scores(texts[600:]) >= 0.5
    assert (said == (y[600:] == 1)).mean() > 0.95
    long = " ".join(f"w{i % 3000}" for i in range(40_000))
    assert model.scores([long + " idiot"])[0] >= 0.5 > model.scores([long])[0]
    assert np.all((model.scores(["", None]) >= 0) & (model.scores(["", None]) <= 1))


@pytest.mark.parametrize("y", [[], [0, 0, 0], [1, 1]])
def test_classifier_with_one_class(y):
    model = toxicity.train(["a b"] * len(y), np.array(y), ["en"] * len(y))
    assert np.allclose(model.scores(["x", ""]), np.mean(y) if y else 0, atol=1e-3)


def test_toxicity_tables(spark, docs_of):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    import zlib

    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    odd = docs_of([(1, None), (1, None), (None, "x"), (2, "")], lang=None).withColumnRenamed("source", "score")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs_of([]), model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if not r.flagged}
    assert toxicity.fit(docs, labels.limit(0)).scores(["x"])[0] < 0.01


def naive_pooled(model, words):
    """Largest activation of each filter over one text's words, word by word, and where it is."""
    x = [model.tables[0][a] + model.tables[1][b] for a, b in toxicity._buckets(words).T]
    value, where = [], []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best, at = 0.0, -1
            for i in range(len(x) - width + 1):
                act = float(model.biases[k][f]) + sum(float(x[i + j] @ model.filters[k][j][:, f]) for j in range(width))
                if act > best:
                    best, at = act, i
            value.append(best)
            where.append(at)
    return np.array(value), where


def test_convolution_and_pooling_against_a_naive_model():
    rng = np.random.default_rng(5)
    hs = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 2, 3, 40, 7)]
    model = toxicity._init(hs, np.array([0, 1, 0, 1, 0, 1]), rng)
    model.biases = [rng.normal(0, 0.3, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    model.training = True
    sizes = np.array([len(h) for h in hs])
    value, where = model.pooled(toxicity._buckets(np.concatenate(hs)), sizes)
    starts = np.cumsum(sizes) - sizes
    for k, h in enumerate(hs):
        want, at = naive_pooled(model, h)
        assert np.allclose(value[k], want, atol=1e-5)
        assert all(w < 0 or abs(value[k, c] - want[c]) < 1e-5 for c, w in enumerate(where[k])) and [(w - starts[k] if w >= 0 else -1) for w in where[k]] == at


def test_gradients_against_finite_differences(monkeypatch):
    rng = np.random.default_rng(6)
    hs = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (5, 9, 4)]
    y = np.array([1.0, 0.0, 1.0])
    model = toxicity._init(hs, y, rng)
    model.tables = [t.astype(np.float64) for t in model.tables]
    model.filters, model.biases = [f.astype(np.float64) for f in model.filters], [b.astype(np.float64) + 1.2 for b in model.biases]
    model.out, model.training = model.out.astype(np.float64) + rng.normal(0, 0.3, len(model.out)), True
    got = {}
    monkeypatch.setattr(toxicity._Adam, "step", lambda self, key, w, g, rows=None: got.__setitem__(key, (g, rows)))
    toxicity._epoch(model, toxicity._Adam(0.1), hs, y, np.arange(3))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss():
        total = 0.0
        for h, label, w in zip(hs, y, weight, strict=True):
            z = naive_pooled(model, h)[0] @ model.out[:-1] + model.out[-1]
            total += w * (np.log1p(np.exp(z)) - label * z) / 3
        return total

    def slope(a, at, eps=1e-5):
        old = a[at]
        a[at] = old + eps
        up = loss()
        a[at] = old - eps
        down = loss()
        a[at] = old
        return (up - down) / (2 * eps)

    for k in range(len(toxicity.WIDTHS)):
        for at in ((0, 0, 0), (k, 3, 5)):
            assert abs(got[f"f{k}"][0][at] - 1e-4 * model.filters[k][at] - slope(model.filters[k], at)) < 1e-4
        assert abs(got[f"b{k}"][0][2] - slope(model.biases[k], 2)) < 1e-4
    assert abs(got["out"][0][4] - 1e-4 * model.out[4] - slope(model.out, 4)) < 1e-4
    g, rows = got["t0"]
    for r in (0, len(rows) // 2):
        assert abs(g[r, 1] - slope(model.tables[0], (rows[r], 1))) < 1e-4


def test_a_language_has_its_own_threshold_where_it_gains():
    rng = np.random.default_rng(7)
    texts, y, langs = [], [], []
    for i in range(1600):
        lang, toxic = ("aa", "bb")[i % 2], rng.random() < 0.5
        word = "vile" if toxic else "fair"
        if lang == "bb" and rng.random() < 0.45:  # here a third word means toxic, which is rare elsewhere
            word = "odd" if toxic else "fair"
        texts.append(" ".join([word, *rng.choice(["one", "two", "three", "four"], 5)]))
        y.append(int(toxic))
        langs.append(lang)
    model = toxicity.train(texts, np.array(y), langs)
    score = model.scores(texts)
    for lang in ("aa", "bb"):
        own = np.array(langs) == lang
        cut = model.thresholds[lang]
        assert 0 < cut < 1 and ((score[own] >= cut) == np.array(y)[own]).mean() >= ((score[own] >= 0.5) == np.array(y)[own]).mean() - toxicity.SPARE
    score = np.array([0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 0.8, 0.9])
    assert 0.3 < toxicity._best_threshold(score, np.array([0, 0, 0, 1, 1, 1, 1, 1])) < 0.35
    assert 0.45 < toxicity._best_threshold(score, np.array([0, 0, 0, 0, 0, 0, 1, 1])) < 0.8
