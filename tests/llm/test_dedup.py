import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from tabulon.llm import exact_dedup, jaccard_join
from tabulon.llm._store import Scratch
from tabulon.llm.components import connected_components

SPACE = r"[\x20\x09-\x0D]+"


def norm(t):
    return re.sub(SPACE, " ", t or "")


def brute_exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in pairs)


def texts(rng, n):
    base = ["".join(rng.choice("ab \n\té漢😀") for _ in range(rng.choice([0, 1, 7, 40, 200]))) for _ in range(n // 3)]
    return [(i, rng.choice(base) if rng.random() < 0.7 else rng.choice(base).replace(" ", rng.choice(["  ", "\t", " "]))) for i in range(n)]


def exact(docs, **kw):
    return sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup.exact_dedup(docs, **kw).collect())


def test_exact_against_brute_force(docs_of):
    pairs = texts(random.Random(3), 120) + [(500, None), (501, ""), (502, " "), (503, "x" * 5000), (504, "x" * 5000), (505, "x" * 4999 + "y")]
    assert exact(docs_of(pairs)) == brute_exact(pairs)
    assert exact(docs_of(pairs), block_chars=16) == brute_exact(pairs)


def test_colliding_hashes_dont_join_texts(docs_of):
    pairs = texts(random.Random(4), 60)
    assert exact(docs_of(pairs), block_chars=8, hash_bits=2) == brute_exact(pairs)


def test_exact_odd_tables(spark, docs_of):
    assert exact(docs_of([])) == []
    rows = exact_dedup.exact_dedup(docs_of([(1, "a b"), (1, "a b"), (1, "c"), (None, "c"), (None, "d")]).withColumn("h", F.lit(0)).withColumn("name", F.lit("x"))).collect()
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    assert len(rows) == 5 and got == {(1, 1, 2, True), (1, 1, 2, True), (1, 1, 2, True), (None, 1, 2, False), (None, None, 1, True)}


def test_keep_one_has_all_columns(docs_of):
    docs = docs_of([(1, "a  b"), (2, "a b"), (3, "c")])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(pairs, n, percent):
    sets = {i: shingle_set(t, n) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i)) for i in sets}


def near_copies(rng, families=12, size=9):
    out = []
    for _ in range(families):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 3, 8, 25, 60, 150, 400]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"]
            out.append(" ".join(own).capitalize())
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{passage} " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(k)) for k in range(0, 30)]
    rng.shuffle(out)
    return list(enumerate([*out, "", None, "one", "One two", "a a a a a a a"]))


def components(docs, **kw):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, **kw).collect()}


def test_jaccard_against_brute_force(docs_of):
    pairs = near_copies(random.Random(5))
    assert components(docs_of(pairs)) == brute_components(pairs, 3, 90)
    assert components(docs_of(pairs), n=5, threshold=0.8, fragments=3) == brute_components(pairs, 5, 80)


def test_names_that_clash_are_told_apart(docs_of):
    pairs = near_copies(random.Random(15))
    assert components(docs_of(pairs), name_bits=3) == brute_components(pairs, 3, 90)


def test_jaccard_one_large_family(docs_of):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    pairs = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            own[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        pairs.append((i, " ".join(own)))
    assert components(docs_of(pairs)) == brute_components(pairs, 3, 90)


def brute_links(pairs, n, percent):
    sets = {i: shingle_set(t, n) for i, t in pairs}
    linked = {i: [] for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            linked[a].append(b)
            linked[b].append(a)
    classes = {i: min((j for j in sets if sets[j] == sets[i] and sets[i]), default=i) for i in sets}
    distinct = {(min(x), max(x), len(sets[a] & sets[b])) for a in sets for b in linked[a] if sets[a] != sets[b] for x in [(classes[a], classes[b])]}
    return {(i, classes[i], len(linked[i])) for i in sets}, distinct


def test_every_link_of_a_family_is_counted(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    rng = random.Random(8)
    pairs = []
    for i in range(70):  # more near copies than HUBS, of which some are equal
        own = [f"w{k}" for k in range(200)]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            own[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        pairs.append((i, " ".join(own)))
    pairs += [(1000 + i, t) for i, t in near_copies(rng, families=4)]
    counted, distinct = brute_links(pairs, 3, 90)
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_links(docs_of(pairs)).collect()} == counted
    got = [tuple(r) for r in jaccard_join.jaccard_pairs(docs_of(pairs)).collect()]
    assert set(got) == distinct and len(got) == len(distinct)


def test_jaccard_odd_tables(docs_of):
    assert components(docs_of([])) == set()
    assert components(docs_of([(7, None), (8, " ")])) == {(7, 0, 7), (8, 0, 8)}
    docs = docs_of([(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, None)]).withColumn("node", F.lit(1)).withColumn("token", F.lit(1))
    assert components(docs) == {(1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 0, None)}
    kept = jaccard_join.keep_one(docs, n=3, threshold=0.9)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.filter("doc_id is not null").collect()] == [1, 1]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}}
    assert connected_components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
