import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from compare import DATA
from tabulon.llm import _bpe, _lattice, queries, simple8b, sp_nbest, unigram_count
from tabulon.llm._store import new_path

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "b,", "'s", "1", "é", "<|endoftext|>", " x", "漢", "​", "▁", "😀", "the", "ing", "\x00"]


def odd(rng, n, parts=ODD):
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_cached_encoding_is_the_tokenizers_own():
    enc = _bpe.CachedEncoder(BPE, cache=50)  # so small that it is full and cleared
    texts = odd(random.Random(1), 3000)
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        ids, sizes = enc.encode(part)
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [2, 300, 50257, 2**32])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n).astype(np.uint32)
    if top == 300 and n:
        ids[rng.integers(0, n, n // 10 + 1)] = 50256
    words, escapes, word_at, escape_at = simple8b.pack(ids)
    assert (simple8b.decode_blocks(words, escapes, word_at, escape_at, n) == ids).all()
    for k in range(len(word_at) - 1):  # each block alone
        got = simple8b.decode_blocks(words, escapes, word_at, escape_at, n, k, k + 1)
        assert (got == ids[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()
    (d, lengths, back, _, _), = simple8b.frames(simple8b.frame([5, None], np.array([n, 0]), ids) + b"\n")
    assert d == [5, None] and lengths.tolist() == [n, 0] and (back == ids).all()


def test_token_files(spark, docs_of):
    rng = random.Random(2)
    pairs = [(i, t) for i, t in enumerate(odd(rng, 300))] + [(1000, None), (1001, "word " * 30_000)]
    rng.shuffle(pairs)
    to = new_path(spark, "test-tokens")
    simple8b.write_token_files(docs_of(pairs).repartition(5), to, BPE, frame_ids=500)
    rows = sorted(simple8b.read_token_files(spark, to).collect(), key=lambda r: r.doc_id)
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    at = 0
    for r, (i, text) in zip(rows, sorted(pairs), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_added_tokens_get_their_ids():
    plain, enc = Tokenizer.from_file(BPE), _bpe.CachedEncoder(BPE, cache=50, added=True)  # the library as it is
    texts = ["one <|endoftext|> two", "<|endoftext|>", "", "a  <|endoftext|>\n<|endoftext|><|endoftext|> b", "c\n", *odd(random.Random(9), 2000)]
    for lo in range(0, len(texts), 100):
        ids, sizes = enc.encode(texts[lo : lo + 100])
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 100]]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert enc.encode(texts[:1])[0].tolist() == [505, 220, 50256, 734]


def test_the_query_encodes_as_the_library(spark, tmp_path):
    rows = [(1, "one <|endoftext|> two"), (2, "three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, str(tmp_path)).collect()}
    assert got[1] == (0, 5, zlib.crc32(np.array([505, 220, 50256, 734, 2], "<u4").tobytes())) and got[2][0] == 5


def test_every_selector_is_used_where_it_fits():
    for sel, (count, bits) in simple8b.LAYOUTS.items():
        ids = np.full(count * 4, (1 << min(bits, 32)) - 1 - (bits < simple8b.ESCAPED_BELOW), dtype=np.uint32)
        words = simple8b.pack(ids)[0]
        assert len(words) == 4 and set((words & np.uint64(15)).tolist()) == {sel}
    escaped = np.array([1, 2, 50_000, 3, 1, 2, 50_001, 3, 1, 2] * 6, dtype=np.uint32)  # two escapes in a word of many
    assert len(simple8b.pack(escaped)[0]) <= 7


def test_frames_follow_their_tasks_and_not_their_files(spark, tmp_path):
    for name, part, nth, doc in (("z", 9, 0, 1), ("y", 10, 0, 2), ("x", 10, 1, 3), ("w", 100, 0, 4)):
        (tmp_path / name).write_bytes(simple8b.frame([doc], np.array([3]), np.arange(3), part, nth) + b"\n")
    assert {r.doc_id: r.start for r in simple8b.read_token_files(spark, str(tmp_path)).collect()} == {1: 0, 2: 3, 3: 6, 4: 9}


def test_ids_that_the_files_cannot_hold(spark):
    with pytest.raises(TypeError, match="whole number"):
        simple8b.write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "nowhere", BPE)


def test_token_files_odd_tables(spark, docs_of):
    for pairs in ([], [(None, "b"), (1, "a"), (1, "a"), (None, None)]):
        to = new_path(spark, "test-tokens")
        simple8b.write_token_files(docs_of(pairs).withColumnRenamed("lang", "frame"), to, BPE)
        rows = simple8b.read_token_files(spark, to).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, 1 + bool(t)) for i, t in pairs)


@pytest.fixture(scope="module")
def lat():
    return _lattice.Lattice(PIECES)


@pytest.fixture(scope="module")
def unigram(lat):
    t = Tokenizer(models.Unigram(list(zip(lat.pieces, lat.scores, strict=True)), unk_id=lat.unknown_id, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


def real_texts(n=60):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/documents.parquet")["text"].to_pylist()[:n]


def test_counts_and_ids_are_the_tokenizers_own(lat, unigram):
    texts = [t for t in odd(random.Random(3), 3000) + real_texts() if t[:1] not in (" ", "▁")]
    counts, scores = unigram_count.WordCounts(lat, cache=100).of(texts)
    seg = sp_nbest.Segmenter(lat, cache=10**6)
    for t, n, s, (ws, rows) in zip(texts, counts, scores, seg.encode(texts), strict=True):
        want = unigram.encode(t, add_special_tokens=False).ids
        ids = seg.ids(rows).tolist()
        assert ids == want and n == len(want), t
        assert lat.decode(ids) == t.replace("▁", " ")
        assert s == seg.score[rows].sum() and len(ws) == len(rows)


def test_names_of_special_pieces_are_text(lat):
    seg = sp_nbest.Segmenter(lat)
    (_, rows), = seg.encode(["</s> <0x0A><unk>"])
    ids = seg.ids(rows).tolist()
    assert lat.decode(ids) == "</s> <0x0A><unk>" and lat.unknown_id not in ids


def every(lat, text):
    into, out = lat.edges(text), []

    def go(at, score, ids):
        if not at:
            out.append((score, ids))
        for start, x, own in into[at] if at else ():
            go(start, score + x, own + ids)

    go(len(text), 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("word", ["the", "ing", "hello", "tionre", "éeau", "x漢x", ""])
def test_nbest_of_a_word(lat, word):
    want = every(lat, "▁" + word)
    got = lat.nbest(word, 7)
    assert [p.score for p in got] == [s for s, _ in want[:7]] and len({p.ids for p in got}) == len(got)
    ids, score, gap = lat.best("▁" + word)
    assert tuple(ids) == got[0].ids and score == got[0].score
    assert gap == (want[0][0] - want[1][0] if len(want) > 1 else float("inf"))


@pytest.mark.parametrize("text", ["the ing hello", "a b c", "tion", ""])
def test_nbest_of_a_text(lat, text):
    seg = sp_nbest.Segmenter(lat)
    (words, rows), = seg.encode([text])
    per_word = [[s for s, _ in every(lat, "▁" + w)] for w in words]
    want = sorted((sum(x) for x in itertools.product(*per_word)), reverse=True)[:6]
    assert [s for s, _ in seg.nbest(words, rows, 6)] == want


@pytest.mark.parametrize("text", ["x" * 1_000_000, "漢字" * 500_000, "item one\n".replace(" ", "") * 120_000])
def test_a_long_text_without_spaces(lat, text, monkeypatch):
    seg = sp_nbest.Segmenter(lat)
    (words, rows), = seg.encode([text])
    best = lat.best("▁" + text)
    scores = [s for s, _ in seg.nbest(words, rows, 4)]
    second = [best[1] - best[2]] if np.isfinite(best[2]) else []  # a text may have one segmentation only
    assert scores[:2] == [best[1], *second] and best[1] == seg.score[rows[0]] and scores == sorted(scores, reverse=True)
    assert lat.decode(seg.ids(rows)) == text
    monkeypatch.setattr(sp_nbest, "POOL", 100)  # what is remembered is bounded by ids, too
    seg.encode(["a b"])
    assert len(seg.at) == 2


def test_token_tables(spark, docs_of, lat):
    pairs = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, " a  b "), (4, "x" * 20_000), (5, "word " * 20_000)]
    docs = docs_of(pairs).withColumnRenamed("lang", "score")
    counts = {r.doc_id: (r.n_tokens, r.score) for r in unigram_count.count_tokens(docs, PIECES).collect()}
    rows = sp_nbest.encode(docs, PIECES).collect()
    assert len(rows) == 7 and all(r.round_trip and r.n_ids == len(r.ids) and r.nbest_scores[0] == r.score for r in rows)
    for r in rows:
        assert counts[r.doc_id] == (r.n_ids, r.score) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert sorted(r.nbest_scores, reverse=True) == r.nbest_scores
    assert counts[2] == (0, 0.0) and unigram_count.count_tokens(docs_of([]), PIECES).count() == 0 == sp_nbest.encode(docs_of([]), PIECES).count()


def test_words_together_are_as_words_alone():
    lat, rng = _lattice.lattice(PIECES), random.Random(21)
    words = ["".join(rng.choice("abcdeiouthé.,\n漢😀x" + lat.apart) for _ in range(rng.choice([0, 1, 2, 5, 12, 70]))) for _ in range(600)]
    ids, sizes, score, gap = lat.best_of_all(words)
    ends = np.cumsum(sizes)
    for k, w in enumerate(words):
        assert (ids[ends[k] - sizes[k] : ends[k]].tolist(), score[k], gap[k]) == lat.best("▁" + w)
    seg = sp_nbest.Segmenter(lat, cache=50)  # words are forgotten and learned again
    for _ in range(4):
        rng.shuffle(words)
        for some in (words[:90], words[90:200], [" ".join(words[200:400])]):
            for text, (own, rows) in zip(some, seg.encode(some), strict=True):
                assert seg.ids(rows).tolist() == [i for w in lat.words(text) for i in lat.best("▁" + w)[0]]
                assert own == lat.words(text) and seg.ok[rows].all()


def test_unknown_characters_are_segmented_with_the_others(monkeypatch):
    lat = _lattice.lattice(PIECES)
    words = ["the.\nThe", "\n", "a\x00b", "\U0001f9ff", "né\n漢", "the", ""]
    want = [lat.best("▁" + w) for w in words]
    monkeypatch.setattr(_lattice.Lattice, "best", None)  # one at a time, a line feed in a word took most of the time
    monkeypatch.setattr(_lattice.Lattice, "words", None)  # and so did words that came up before
    ids, sizes, score, gap = lat.best_of_all(words)
    ends = np.cumsum(sizes)
    assert [(ids[e - n : e].tolist(), s, g) for e, n, s, g in zip(ends, sizes, score, gap, strict=True)] == want
    (own, rows), = sp_nbest.Segmenter(lat).encode([" ".join(words)])
    assert own == words


def test_rows_of_a_slice():
    lat = _lattice.lattice(PIECES)
    texts = pa.array(["no", None, "", "a b\u2581c", " ", "", None, "b  a\nd", "no"])[1:-1]
    seg = sp_nbest.Segmenter(lat)
    rows, counts = seg.rows(texts)
    words = [lat.words(t or "") for t in texts.to_pylist()]
    assert counts.tolist() == [len(w) for w in words] and [seg.names[r] for r in rows] == [w for ws in words for w in ws]
    assert [len(seg.rows(pa.array(t, pa.string()))[0]) for t in ([], [None], [""])] == [0, 0, 0]


def test_trie_finds_all_pieces_and_no_others(monkeypatch):
    rng = random.Random(5)
    ids = {w: i for i, w in enumerate({"".join(rng.choice("abcé漢") for _ in range(rng.randrange(1, 5))) for _ in range(200)})}
    for tries in (_lattice.Trie.TRIES, 0):  # with none, everything goes to the end
        monkeypatch.setattr(_lattice.Trie, "TRIES", tries)
        trie = _lattice.Trie(ids)
        for n in range(1, 6):
            for text in map("".join, itertools.product("abcé漢x", repeat=n)):
                state = 0
                for c in text:
                    to = trie.base[state] + trie.classes[ord(c)]
                    state = to if trie.owner[to] == state else len(trie.base) - 1
                assert trie.piece[state] == ids.get(text, -1)


def test_remembered_ways_are_bounded_by_their_ids(monkeypatch):
    monkeypatch.setattr(sp_nbest, "WAYS", 3000)
    seg, rng = sp_nbest.Segmenter(_lattice.lattice(PIECES)), random.Random(8)
    for _ in range(20):
        words = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(3)]
        (own, rows), = seg.encode([" ".join(words)])
        assert [s for s, _ in seg.nbest(own, rows, 4)] == seg.best_scores(rows, np.array([3]), 4)[0]
    assert 0 < sum(len(p.ids) for got in seg.ways.values() for p in got) < 3000 + 4 * 200
