import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import MigrationError, SyncError
from tabulon.functions import keys
from tabulon.functions.json_text import array_text, check_array_path, json_value, plain_base64
from tabulon.functions.porter import stem
from tabulon.plans import sqlapi, versions
from tabulon.schema import Entity, Field, InvalidSchema
from tabulon.sources import files, sqlite
from tabulon.streaming import cdc, sync

E = Entity("t", [Field("id", T.LongType()), Field("v", T.StringType(), True), Field("updated_at", T.LongType(), True)], ["id"], timestamps=False)


def test_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id long, v string, updated_at long")
    new = spark.createDataFrame([(1, "a", 2), (2, "B", 2), (4, "d", 2)], "id long, v string, updated_at long")
    assert sorted((r.id, r.operation) for r in cdc.snapshot_diff(E, old, new).collect()) == [(2, "update"), (3, "delete"), (4, "insert")]
    assert cdc.bootstrap_events(new, E, old).count() == 1


def test_versions_and_clock_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, s, rng.choice([0, -3, 5, 100, 7])) for k in range(3) for s in range(60)]
    df = spark.createDataFrame(rows, "k long, s long, now long")
    want_v, want_c = {}, {}
    for k in range(3):
        known, last, count = None, 0, 0
        for _, s, now in sorted(r for r in rows if r[0] == k):
            known = now if known is None else max(now, known + 1)
            want_v[k, s] = known
            if now > last:
                last, count = now, 0
            else:
                count += 1
            want_c[k, s] = (last << 16) | count
    assert {(r.k, r.s): r.version for r in cdc.monotone_versions(df, ["k"], "s", "now").collect()} == want_v
    assert {(r.k, r.s): r.clock for r in cdc.hybrid_clock(df, ["k"], "s", "now").collect()} == want_c


def test_monotone_versions_golden(spark):
    df = spark.createDataFrame([(1, 1, 10000), (1, 2, 1), (1, 3, 1), (1, 4, 1)], "k long, s long, now long")
    assert [r.version for r in cdc.monotone_versions(df, ["k"], "s", "now").orderBy("s").collect()] == [10000, 10001, 10002, 10003]


STATE = "entity_type string, sync_key string, version_ms long, deleted boolean, payload string"


def test_tombstones(spark):
    state = spark.createDataFrame([("n", "a", 30, True, None)], STATE)
    for at, alive in ((20, 0), (40, 1)):
        page = spark.createDataFrame([("n", "a", at, False, '{"x": 1}')], STATE)
        after = sync.apply_changes(state, page)
        assert after.count() == 1 and sync.live(after).count() == alive


def test_effects(spark):
    state = spark.createDataFrame([("n", "a", 5, False, '{"x": 1, "y": 2}'), ("n", "b", 5, False, "{}"), ("n", "c", 5, False, "{}")], STATE)
    page = spark.createDataFrame([("n", "a", 5, False, '{"y": 2, "x": 1}'), ("n", "b", 4, False, "{}"), ("n", "c", 5, True, None), ("n", "d", 1, False, "{}")], STATE)
    assert {r.sync_key: r.effect for r in sync.effects(state, page).collect()} == {"a": "same", "b": "stale", "c": "apply", "d": "apply"}


def test_pages_are_whole(spark):
    schema = STATE + ", schema_version int"
    good = [("n", "a", 1, False, "{}", 1)]
    assert sync.check_page(spark.createDataFrame(good, schema), 1).count() == 1
    for bad in (("n", "b", 1, False, "no json", 1), ("n", None, 1, True, None, 1), ("n", "c", 1, True, None, 2)):
        with pytest.raises(SyncError):
            sync.check_page(spark.createDataFrame([*good, bad], schema), 1)


def test_upload_batch(spark):
    schema = "seq long, entity_type string, sync_key string, operation string, payload string, created_at long"
    log = spark.createDataFrame([(1, "n", "a", "insert", "{}", 1), (2, "n", "b", "insert", "{}", 2), (3, "n", "a", "update", '{"v":1}', 3), (4, "n", "c", "update", "{}", 2), (5, "n", "d", "update", "{}", 9)], schema)
    got = {r.sync_key: (r.operation, r.seq, r.covered) for r in sync.upload_batch(log, 0).collect()}
    assert got == {"a": ("update", 3, [1, 3]), "b": ("insert", 2, [2])}  # 4 goes back in time
    assert sync.upload_batch(log, 0, 1).count() == 1 and sync.upload_batch(log, 0, local_only=("n",)).isEmpty()
    with pytest.raises(ValueError):
        sync.upload_batch(log, 0, 201)
    sent = sync.upload_batch(log, 0)
    ok = spark.createDataFrame([("n", "a", 3), ("n", "b", 2)], "entity_type string, sync_key string, seq long")
    assert sync.check_receipts(sent, ok).isEmpty()
    assert sync.check_receipts(sent, ok.withColumn("seq", F.lit(1))).count() == 2


@pytest.mark.parametrize(("done", "cursor"), [([True, False, False], 1), ([True, True, True], 101), ([False, True, True], 0)])
def test_prefix_cursor(spark, done, cursor):
    df = spark.createDataFrame(list(zip([1, 2, 101], done, strict=True)), "seq long, done boolean")
    assert sync.prefix_cursor(df, F.col("done")).first().cursor == cursor


def test_stream(spark, tmp_path):
    schema = STATE + ", schema_version int"
    store = versions.Versions(spark, str(tmp_path / "state"))
    store.publish(spark.createDataFrame([], STATE))
    src = tmp_path / "src"
    spark.createDataFrame([("n", "a", 5, False, "{}", 1), ("n", "a", 9, True, None, 1)], schema).write.parquet(str(src))
    spark.createDataFrame([("n", "a", 7, False, "{}", 1), ("n", "b", 1, False, "{}", 1)], schema).write.mode("append").parquet(str(src))
    q = sync.sync_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), store.read, lambda df, n: store.publish(df), str(tmp_path / "cp"), 1)
    q.awaitTermination(120)
    assert {(r.sync_key, r.version_ms, r.deleted) for r in store.read().collect()} == {("a", 9, True), ("b", 1, False)}


def test_versions_and_migrations(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "t"))
    assert store.current() == 0
    with pytest.raises(MigrationError):
        store.read()
    df = spark.range(3)
    assert store.publish(df) == 1 and store.publish(df.limit(1)) == 2
    assert store.read().count() == 1 and store.read(1).count() == 3
    store.backup(str(tmp_path / "copy"))
    with pytest.raises(Exception, match="exists"):
        store.backup(str(tmp_path / "copy"))

    a, b = T.StructType([T.StructField("id", T.LongType())]), T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType())])
    assert versions.Delta.between({"t": a}, {"t": b, "u": a}).apply({"t": a}) == {"t": b, "u": a}
    with pytest.raises(MigrationError):
        versions.Delta({}, ("x",)).apply({"t": a})
    steps = [versions.Migration("one", {"t": a}, lambda t: {"t": spark.range(2)}), versions.Migration("two", {"t": b}, lambda t: {"t": t["t"].withColumn("n", F.lit("x"))})]
    tables, history = versions.migrate({}, steps, [])
    assert history == ["one", "two"] and tables["t"].columns == ["id", "n"]
    assert versions.migrate(tables, steps, history)[1] == history
    with pytest.raises(MigrationError):
        versions.pending(steps, ["two"])
    with pytest.raises(MigrationError):
        versions.migrate({}, [versions.Migration("bad", {"t": b}, lambda t: {"t": spark.range(1)})], [])
    assert versions.adopt({"t": spark.range(1)}, steps[0], []) == ["one"]
    assert "withColumn('n'" in versions.migration_stub("m", {"t": a}, {"t": b}) and "NotImplementedError" in versions.migration_stub("m", {"t": b}, {"t": a})
    assert versions.canonical_json({"b": a, "a": a}).index('"a"') < versions.canonical_json({"b": a, "a": a}).index('"b"')


def test_nullability_and_the_order_of_migrations(spark):
    want = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("n", T.StringType())])
    df = spark.createDataFrame([(1, "x")], "id long, n string")
    assert versions.drift({"t": want}, {"t": df}) == [] and versions.drift({"t": want}, {"t": df}, nullability=True) == ["t.id may be null"]
    assert versions.drift({"t": want}, {"t": spark.range(1).withColumn("n", F.lit("x"))}, nullability=True) == []
    assert versions.in_order(["10_c", "9_b", "0001_a"]) == ["0001_a", "9_b", "10_c"]
    for bad in (["a"], ["1_a", "01_b"]):
        with pytest.raises(MigrationError):
            versions.in_order(bad)


def test_keys_and_names(spark):
    for parts in (["a@b"], [1, "x"], [b"0" * 16, b"12", 1.5]):
        assert keys.decode_key(keys.encode_key(parts)) == parts
    with pytest.raises(ValueError):
        keys.encode_key([None])
    df = spark.createDataFrame([("x", 3)], "s string, n long")
    assert bytes(df.select(keys.key_bytes(F.col("s"), F.col("n"))).first()[0]) == keys.encode_key(["x", 3])
    raw = keys.uuid7(1_700_000_000_123)
    assert keys.uuid7(5) < raw and keys.uuid7_time(raw).timestamp() == 1_700_000_000.123
    t = spark.createDataFrame([(raw,)], "b binary").select(F.unix_millis(keys.uuid7_timestamp(F.col("b")))).first()[0]
    assert t == 1_700_000_000_123
    assert spark.range(1).select(keys.to_unix_seconds(keys.from_unix_seconds(F.lit(1.5)))).first()[0] == 1.5


@pytest.mark.parametrize(
    ("doc", "path", "want"),
    [
        ('{"c":[{"p":[{"t":"first"},{"t":"second"}]},{"p":[{"t":"third"},{"t":null}]},{"p":null}]}', "$.c.p.t", "first\nsecond\nthird"),
        ('{"c":[{"t":1},{"t":"x"},{"t":{"u":"y"}},[{"t":"z"}]]}', "$.c.t", "x\nz"),
        ("not json", "$.c", ""),
        (None, "$.c", ""),
        ('["a",["b",1]]', "$", "a\nb"),
    ],
)
def test_array_text(spark, doc, path, want):
    assert spark.createDataFrame([(doc,)], "j string").select(array_text(F.col("j"), path)).first()[0] == want


def test_array_path_rules():
    for bad in ("a.b", "$.a[0]", "$..a", '$.a"'):
        with pytest.raises(InvalidSchema):
            check_array_path(bad)


def test_encodings(spark):
    row = spark.createDataFrame([(b"Hello", 'q"\n', None, True)], "b binary, s string, n long, f boolean")
    got = row.select(json_value(F.col("b"), T.BinaryType()), json_value(F.col("s"), T.StringType()), json_value(F.col("n"), T.LongType()), json_value(F.col("f"), T.BooleanType())).first()
    assert list(got) == ['{"_type":"blob","base64":"SGVsbG8=","size":"5"}', '"q\\"\\n"', "null", "1"]
    assert "\n" not in spark.createDataFrame([(b"x" * 200,)], "b binary").select(plain_base64(F.col("b"))).first()[0]
    assert row.select(sqlapi.as_csv(row.select("s", "n"))).first()[0] == '"q""\n",'


@pytest.mark.parametrize(("total", "size", "pages"), [(25, 10, 3), (20, 10, 2), (0, 10, 1)])
def test_pages(spark, total, size, pages):
    spark.range(total).createOrReplaceTempView("pg")
    got = sqlapi.query_page(spark, "SELECT id FROM pg ORDER BY id", page=pages, size=size)
    assert got.total_pages == pages and got.total == total
    for bad in ("", "DELETE FROM pg"):
        with pytest.raises(sqlapi.QueryFailed):
            sqlapi.check_query(bad)
    with pytest.raises(sqlapi.ReadOnlyViolation):
        sqlapi.check_execute("DROP TABLE x", True)
    assert sqlapi.parameter(True) == 1 and sqlapi.parameter([1]) == "[1]"


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER, name TEXT, v REAL, b BLOB)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i if i else None, f"n{i}", i / 2, b"\x01") for i in range(100)])
    sqlite.register(spark)
    reader = spark.read.format("tabulon_sqlite").option("path", path).option("table", "t")
    assert reader.load().count() == 100
    many = reader.option("partitions", 4).option("key", "id").load()
    assert many.rdd.getNumPartitions() == 4 and many.count() == 100 and many.filter("id = 7").first().name == "n7"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("b.txt", "x"), ("A.txt", "yy"), ("d/c.txt", "z"), (".hidden", "h")):
        (tmp_path / name).write_text(text)
    got = [(r.name, r.is_directory) for r in files.listing(spark, str(tmp_path)).collect()]
    assert got == [("d", True), ("A.txt", False), ("b.txt", False)]
    mine = files.digests(spark, str(tmp_path)).filter("path not like '.%'")
    theirs = mine.filter("path <> 'b.txt'").withColumn("sha256", F.when(F.col("path") == "A.txt", "0").otherwise(F.col("sha256")))
    assert {r.path: r.state for r in files.file_states(mine, theirs).collect()} == {"b.txt": "new", "A.txt": "conflict", "d/c.txt": "synced"}
    wanted = spark.createDataFrame([("d/c.txt",), ("d/c.txt",), ("nowhere",), (None,)], "path string")
    assert [r.path for r in files.file_states(mine, theirs, wanted).collect()] == ["d/c.txt", "A.txt", "b.txt"]


def test_porter():
    # Pairs given in the paper.
    for a, b in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "hopefulness": "hope", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas"}.items():
        assert stem(a) == b, a
