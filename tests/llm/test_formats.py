import base64
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat_format as chat
from tabulon.llm import queries, warc
from tabulon.llm._store import new_path

NASTY = ["", "\\", "</s>", "[INST] ok [/INST]", "<<SYS>>", "<", "[", "\\\\<s>", "<|end|><|turn|>", "<<s>", "a\nb", "\\n", "<</SYS>", "😀", "<s><s>"]


def test_turns_survive_formatting():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<s>"]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert all(m[2] is None for a, b in spans for m in chat._TOKEN.finditer(text[a:b]))


def test_layouts(spark):
    records = {
        1: {"prompt": "p", "response": "r"},
        2: {"response": "r", "prompt": None},
        3: {"instruction": "s", "input": "u", "output": "a"},
        4: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]},
        5: {"messages": [{"role": "user", "content": "x"}]},
        6: {"messages": []},
        7: {"data": {"question": "q", "answer": 3}},
        8: {"something": "else"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(9, "no json"), (10, None), (11, "[1]")]
    got = {r.id: r for r in chat.format_chats(spark.createDataFrame(rows, "id long, record string").withColumn("turns", F.lit(1))).collect()}
    turns = {k: [tuple(t) for t in r.turns] if r.turns is not None else None for k, r in got.items()}
    assert turns[1] == [("user", "p"), ("assistant", "r")] and turns[2] == [("user", ""), ("assistant", "r")]
    assert turns[3] == [("system", "s"), ("user", "u"), ("assistant", "a")]
    assert turns[4] == [("user", "h"), ("assistant", "g"), ("tool", "t")]
    assert turns[5] == [("user", "x")] and turns[6] == [] and turns[7] == [("user", "q"), ("assistant", "3")]
    assert turns[8] is None and got[8].fingerprint and all(got[k].fingerprint is None for k in (9, 10, 11))
    assert len({r.fingerprint for r in got.values() if r.fingerprint}) == 7


def test_conversations(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 2, None, "c"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a\\</s>"), (None, 0, "user", "n"), (4, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.as_records(df))
    layouts = {r.id: r.layout for r in made.collect()}
    assert layouts == {1: "prompt and response", 2: "messages", 3: "instruction, input and output", None: "messages", 4: "messages"}
    got = {r.id: r for r in chat.read_back(made).collect()}
    said = {1: [("user", "u"), ("assistant", "")], 2: [("user", "a"), ("assistant", "b"), ("", "c")], 3: [("system", "s"), ("user", "u"), ("assistant", "a\\</s>")], None: [("user", "n")], 4: [("user", "x")] * 2}
    for k, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns) and got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_chars == len(loss) and got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[k].formatted_chars == len(chat.render(turns)[0])
    assert chat.as_records(df.limit(0)).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "http://b c\r\n", "same"), (1, "u", None), (2, "u", ""), (4, "u", "é" * 5000), (7, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "u", "lone")]
    to = new_path(spark, "test-warc")
    warc.write_pages(pages_of(spark, rows).withColumn("block", F.lit(1)), to, records_per_file=3)
    got = warc.read_archives(spark, to).collect()
    assert all(r.gap is None for r in got) and len(got) == len(rows)
    by = {r.record_id: r for r in got}
    for i, _, html in rows:
        r, raw = by[f"<{warc.ID_PREFIX}{'null' if i is None else i}>"], (html or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    kinds = {r.record_id.strip("<>").rsplit(":", 1)[1]: (r.record_type, r.refers_to) for r in got}
    assert kinds["3"] == ("response", None) and kinds["5"] == ("revisit", f"<{warc.ID_PREFIX}3>") == kinds["9"]
    assert kinds["1"] == ("response", None) and kinds["2"][0] == "revisit" and kinds["7"] == ("response", None)


def test_small_payloads_are_always_responses(spark):
    to = new_path(spark, "test-warc")
    warc.write_pages(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), to, min_bytes=3)
    assert sorted(r.record_type for r in warc.read_archives(spark, to).collect()) == ["response", "response", "response", "revisit"]


def test_headers_of_any_length(spark, tmp_path):
    rows = [(1, "u", "a"), (2, "data:," + "x" * 300_000, "b"), (3, "u", "c")]
    pages_of(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in queries.op6_warc(spark, str(tmp_path)).collect()) == [1, 2, 3]
    to = new_path(spark, "test-warc")
    warc.write_pages(pages_of(spark, rows), to)
    assert {r.target_uri for r in warc.read_archives(spark, to).collect()} == {u for _, u, _ in rows}


def test_the_query_fails_rather_than_lose_pages(spark, tmp_path, monkeypatch):
    pages_of(spark, [(1, "u", "a")]).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "write_pages", lambda pages, to: pages.selectExpr("'lost' AS value").write.text(to))
    with pytest.raises(Exception, match="can't read back"):
        queries.op6_warc(spark, str(tmp_path)).collect()


def test_no_pages(spark):
    to = new_path(spark, "test-warc")
    warc.write_pages(pages_of(spark, []), to)
    assert warc.read_archives(spark, to).count() == 0


def record(n, payload=b"payload"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(block).digest())
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, digest, len(block), block)


def ids(data):
    found = list(warc.salvage(data))
    assert [r.start for r in found] == sorted(r.start for r in found)
    return [int(r.headers["warc-record-id"][5:-1]) for r in found if not r.reason], [(r.start, r.end) for r in found if r.reason]


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "length", "header", "tail"])
def test_salvage_of_plain_archives(damage):
    parts = [record(k) for k in range(5)]
    good = parts[2]
    parts[2] = {
        "flip": good.replace(b"payload", b"pbyload"),
        "cut": good[:-15],
        "junk": b"\x00\x01garbage",
        "length": good.replace(b"Content-Length: ", b"Content-Length: 9"),
        "header": good.replace(b"WARC-Type: response", b"WARC-Type response"),
        "tail": good[:-4] + b"xxxx",
    }[damage]
    found, gaps = ids(b"".join(parts))
    assert found == [0, 1, 3, 4] and gaps == [(2 * len(good), 2 * len(good) + len(parts[2]))]


def test_salvage_of_gzipped_archives():
    parts = [gzip.compress(record(k), mtime=0) for k in range(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    at = len(parts[0]) + len(parts[1])
    found, gaps = ids(b"".join([*parts[:2], bytes(broken), *parts[3:]]))
    assert found == [0, 1, 3, 4] and gaps == [(at, at + len(broken))]
    found, gaps = ids(b"".join([*parts[:4], parts[4][:-5]]))
    assert found == [0, 1, 2, 3, 4] and not gaps  # what it holds is whole
    found, gaps = ids(b"".join([*parts[:4], parts[4][:-30]]))
    assert found == [0, 1, 2, 3] and len(gaps) == 1
    assert ids(b"") == ([], []) and ids(b"nothing here") == ([], [(0, 12)])


def test_gaps_are_logged_as_rows(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(0) + b"lost bytes" + record(1))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.start, r.end) for r in rows if r.gap] == [(len(record(0)), len(record(0)) + 10)] and sum(r.gap is None for r in rows) == 2


def damaged(raw, at, size=1):
    return raw[:at] + bytes(255 - b for b in raw[at : at + size]) + raw[at + size :]


def test_a_bad_record_in_a_shared_member_costs_no_other():
    bad = damaged(record(2), record(2).index(b"payload"))
    data = gzip.compress(record(0) + record(1) + bad + record(3)) + gzip.compress(record(4))
    assert ids(data)[0] == [0, 1, 3, 4]
    gaps = [r for r in warc.salvage(data) if r.reason]
    assert len(gaps) == 1 and "inflates to" in gaps[0].reason and (gaps[0].start, gaps[0].end) == (0, len(gzip.compress(record(0) + record(1) + bad + record(3))))


def test_a_member_that_breaks_off_or_is_damaged():
    rng = random.Random(4)
    noise = [bytes(rng.randrange(256) for _ in range(3000)) for _ in range(6)]
    raw = gzip.compress(b"".join(record(k, x) for k, x in enumerate(noise)))
    assert ids(raw[:-12])[0][:5] == [*range(5)]
    hurt = damaged(raw, 2 * len(raw) // 3, 40) + record(8) + gzip.compress(record(9))
    found = list(warc.salvage(hurt))
    got = [r.headers["warc-record-id"] for r in found if not r.reason]
    assert got[:3] == ["<urn:0>", "<urn:1>", "<urn:2>"] and got[-2:] == ["<urn:8>", "<urn:9>"]
    assert any(r.reason for r in found) and all(r.start < r.end for r in found)
    assert [r.reason for r in warc.salvage(gzip.compress(b"nothing of the kind"))] and ids(gzip.compress(b"") + record(1))[0] == [1]


def test_many_small_members_take_linear_time():
    import time

    one = gzip.compress(record(1, b"x" * 400), 1)
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert sum(not r.reason for r in warc.salvage(one * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_digests_and_headers_of_every_legal_form():
    block = b"HTTP/1.1 200 OK\r\n\r\nx"
    sha = hashlib.sha1(block)
    b32 = base64.b32encode(sha.digest()).decode()
    for stated, fine in ((b32, True), (b32.lower(), True), (sha.hexdigest(), True), (sha.hexdigest().upper(), True), ("A" * 32, False)):
        raw = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nX-Long: a\r\n b\r\n\tc\r\nWARC-Block-Digest: sha1:{stated}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        found = list(warc.salvage(raw))
        assert bool(found[0].reason) != fine, stated
        assert not fine or found[0].headers["x-long"] == "a b c"


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(i, "u", f"{i} " + "x" * (100 if i % 3 else 200_000 if i % 2 else 700_000)) for i in range(30)]
    to = new_path(spark, "test-warc")
    warc.write_pages(pages_of(spark, rows).coalesce(1), to)
    sizes = [r.length for r in spark.read.format("binaryFile").load(to).select("length").collect()]
    assert max(sizes) < 1.1 * (1 << 20) and len(sizes) > 5
    assert sorted(r.payload_bytes for r in warc.read_archives(spark, to).collect()) == sorted(len(h) for _, _, h in rows)
