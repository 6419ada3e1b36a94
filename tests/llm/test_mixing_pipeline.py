import subprocess
import sys
import unicodedata

import numpy as np
import pytest
from compare import DATA, ROOT, connect, same
from pyspark.sql import functions as F
from test_dedup import brute_components, norm

from tabulon.llm import exact_dedup, jaccard_join, mixing, queries, toxicity


def test_marginals_reach_their_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cells = mixing.rake(docs).collect()
    total = sum(c.tokens for c in cells)
    assert abs(sum(c.weight for c in cells) - 1) < 1e-9 and max(c.probability for c in cells) == 1
    for dim, power in mixing.POWERS.items():
        have, tokens = {}, {}
        for c in cells:
            have[c[dim]] = have.get(c[dim], 0) + c.weight
            tokens[c[dim]] = tokens.get(c[dim], 0) + c.tokens
        want = {k: (t / total) ** power for k, t in tokens.items()}
        norm_ = sum(want.values())
        assert all(abs(have[k] * norm_ / w - 1) <= mixing.TOLERANCE + 1e-9 for k, w in want.items()), dim
    assert {c.deviation for c in cells} == {cells[0].deviation} and cells[0].deviation <= mixing.TOLERANCE


def sparse(docs_of, n):
    """Sources that are mostly of one language each, for which raking takes many rounds."""
    docs = docs_of([(i, "word " * (1 + i % 7)) for i in range(n)])
    source = F.concat(F.lit("s"), F.pmod("doc_id", F.lit(max(3, n // 10))).cast("string"))
    lang = F.concat(F.lit("l"), F.when(F.pmod(F.xxhash64("doc_id"), F.lit(9)) == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(source), F.lit(4))).cast("string"))
    return docs.withColumn("source", source).withColumn("lang", lang)


def test_many_cells_are_raked_as_few_are(docs_of, monkeypatch):
    docs = sparse(docs_of, 400)
    few = {(r.source, r.lang, r.topic): r for r in mixing.rake(docs).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    many = {(r.source, r.lang, r.topic): r for r in mixing.rake(docs).collect()}
    assert few.keys() == many.keys() and all(abs(few[k].probability - many[k].probability) < 1e-9 for k in few)
    assert max(r.deviation for r in many.values()) <= mixing.TOLERANCE
    rows = mixing.mix(docs).collect()
    assert len(rows) == 400 and all(abs(r.probability - few[r.source, r.lang, r.topic].probability) < 1e-8 for r in rows)


def test_targets_that_contradict_the_cells_warn(docs_of):
    docs = docs_of([(i, "a b") for i in range(9)]).withColumn("lang", F.col("source"))
    targets = {"source": {"src0": 0.5, "src1": 0.5}, "lang": {"src0": 0.9, "src1": 0.1}}
    with pytest.warns(UserWarning, match="off by"):
        assert mixing.rake(docs, targets, most_rounds=8).first().deviation > 0.1


def test_columns_that_clash_with_helpers(spark, docs_of):
    names = ["_mix", "_mix_cell", "_mix_p", "_draw", "_tokens", "_source", "_lang", "_topic", "_probability", "_cut", "_norm", "_kept_id", "_kept_sha", "sha", "node", "token", "fp", "n", "level", "name", "probability", "tokens", "threshold", "flagged"]
    docs = docs_of([(i, f"one two three {i % 40}") for i in range(60)])
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(k))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = toxicity.train(["bad word"] * 30 + ["good word"] * 30, np.array([1] * 30 + [0] * 30), ["en"] * 60)
    for keep in (mixing.keep_sampled, exact_dedup.keep_one, jaccard_join.keep_one, lambda d: toxicity.keep_clean(d, model)):
        got = keep(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and {r.doc_id for r in rows} == {r.doc_id for r in keep(plain).collect()}
        assert all([r[c] for c in names] == list(range(len(names))) for r in rows)


def test_given_targets(spark, docs_of):
    pairs = [(i, f"one two three {i}") for i in range(600)]
    docs = docs_of(pairs)
    rows = mixing.mix(docs, targets={"source": {"src0": 3.0, "src1": 1.0}}).collect()
    p = {r.source: r.probability for r in rows}
    assert p["src2"] == 0 and abs(p["src0"] / p["src1"] - 3) < 1e-6
    share = {s: sum(r.sampled for r in rows if r.source == s) for s in p}
    assert share["src0"] == 200 and 35 < share["src1"] < 105 and share["src2"] == 0
    kept = mixing.keep_sampled(docs, targets={"source": {"src0": 3.0, "src1": 1.0}})
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.sampled}


def brute_topic(text):
    """Word beginnings one by one, with no pattern of all stems."""
    counts = dict.fromkeys(mixing.TOPICS, 0)
    for at, c in enumerate(text or ""):
        if at and unicodedata.category(text[at - 1])[0] == "L":
            continue
        for name, own in mixing.TOPICS.items():
            counts[name] += any((c.lower() if c.isascii() else c) + text[at + 1 : at + len(stem)] == stem for stem in own)
    best = max(counts.values())
    return mixing.NO_TOPIC if best == 0 else next(k for k, n in counts.items() if n == best)


def test_topics_of_texts(spark, docs_of):
    texts = [None, "", " ", "law", "Lawyers law", "LAW", "flaw", "élaw law", "law,law music", "music law", "musique\nMuseum court", "the film of 2films (film)", "law " * 5000 + "film " * 5001]
    assert [r.topic for r in mixing.mix(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()] == [brute_topic(t) for t in texts]
    assert [brute_topic(t) for t in texts[3:10]] == ["law", "law", "general", "general", "law", "law", "law"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    said = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.topic == brute_topic(said[r.doc_id]) for r in mixing.mix(docs).collect())


def test_no_stem_begins_another():
    stems = sorted(t for own in mixing.TOPICS.values() for t in own)
    assert len(set(stems)) == len(stems) and not any(b.startswith(a) for a, b in zip(stems, stems[1:], strict=False))


def test_mix_odd_tables(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    rows = mixing.mix(docs_of([(1, None), (2, "a"), (2, "a"), (None, "b")], lang=None, source=None)).collect()
    assert len(rows) == 4 and {r.lang for r in rows} == {""} and [r.probability for r in rows if r.doc_id == 1] == [1]
    assert [r.sampled for r in mixing.mix(docs_of([(1, None), (2, " ")])).collect()] == [False, False]
    own = mixing.mix(docs_of([(1, "a"), (2, "b")]).withColumnRenamed("n_chars", "topic")).collect()
    assert {r.topic for r in own} == {"1"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_query_against_sql(spark, con, name):
    same(queries.queries()[name](spark, DATA), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_registered_query_is_whole(spark, name):
    ids = sorted(r.doc_id for r in queries.queries()[name](spark, DATA).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


def test_stages_one_by_one(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {"documents": [tuple(r) for r in docs.collect()]}
    for name, stage in pipe.STAGES:
        docs = stage(spark, docs, DATA)
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != pipe.STAGES[-1][0]:
            docs = spark.createDataFrame(seen[name], "doc_id long, text string, lang string, source string, n_chars long")
    start, clean, unique, apart, mixed, last = seen.values()
    assert set(clean) <= set(start) and len(clean) > 0.8 * len(start)
    first = {}
    for r in sorted(clean):
        first.setdefault(norm(r[1]), r)
    assert sorted(unique) == sorted(first.values())
    roots = {c for _, _, c in brute_components([(r[0], r[1]) for r in unique], 5, 80)}
    assert {r[0] for r in apart} == roots
    assert set(mixed) <= set(apart) and mixed
    assert {r[0] for r in last} == {r[0] for r in mixed}
    assert len(pipe.run(spark, DATA).collect()) == len(last)


def test_the_rest_works_without_this_subpackage(tmp_path):
    code = (
        "import sys, shutil; shutil.copytree(sys.argv[1], sys.argv[2], ignore=shutil.ignore_patterns('llm', '.git', 'corpus_pipeline.py', '__pycache__'));"
        "sys.path.insert(0, sys.argv[2]); import __spark_entry__ as e; q = e.queries();"
        "assert 'pipeline' not in q and 'q01_filter_order_limit' in q and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code, ROOT, str(tmp_path / "copy")], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
