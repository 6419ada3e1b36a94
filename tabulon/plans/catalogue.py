"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import keys, text
from tabulon.functions.json_text import array_text
from tabulon.operators import fulltext as fts
from tabulon.operators import match_text
from tabulon.operators import mutations as mut
from tabulon.operators.predicates import Columns, raw
from tabulon.plans import sqlapi, versions
from tabulon.plans.entities import KEYS, table
from tabulon.schema import Entity, Field
from tabulon.sources import files
from tabulon.streaming import cdc, sync

Maker = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Maker] = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None):
    """Register a query under its name; without SQL only its rows are checked."""

    def add(f: Maker) -> Maker:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


# Filters


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q01_filter_order_limit(spark, d):
    q = table(spark, d, "orders").filter(lambda c: c.o_totalprice >= 100_000)
    return q.order_desc("o_totalprice").order("o_orderkey").limit(20).select("o_orderkey", "o_totalprice").dataframe()


@registered("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def q02_eq_ne(spark, d):
    q = table(spark, d, "orders").filter(lambda c: c.o_orderstatus == "F").filter(lambda c: c.o_orderpriority != "5-LOW")
    return q.select("o_orderkey", "o_orderstatus", "o_orderpriority").dataframe()


@registered("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 30 AND l_discount >= 0.02 AND l_discount < 0.06")
def q03_range_ops(spark, d):
    q = table(spark, d, "lineitem").filter(lambda c: (c.l_quantity > 10) & (c.l_quantity <= 30) & (c.l_discount >= 0.02) & (c.l_discount < 0.06))
    return q.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").dataframe()


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_19')")
def q04_in_list(spark, d):
    return table(spark, d, "nation").filter(lambda c: c.n_name.is_in(["NATION_1", "NATION_7", "NATION_19"])).select("n_nationkey", "n_name").dataframe()


@registered("SELECT n_nationkey FROM nation WHERE false")
def q04_in_empty(spark, d):
    return table(spark, d, "nation").filter(lambda c: c.n_name.is_in([])).select("n_nationkey").dataframe()


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (0, 2)")
def q05_not_in(spark, d):
    return table(spark, d, "nation").filter(lambda c: c.n_regionkey.not_in([0, 2])).select("n_nationkey", "n_name").dataframe()


@registered("SELECT n_nationkey FROM nation")
def q05_not_in_empty(spark, d):
    return table(spark, d, "nation").filter(lambda c: c.n_name.not_in([])).select("n_nationkey").dataframe()


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def q06_between(spark, d):
    return table(spark, d, "lineitem").where("l_quantity", between=(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity").dataframe()


@registered("SELECT c.c_custkey, o.o_orderkey IS NULL AS no_order FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_orderpriority IS NOT NULL")
def q07_null_checks(spark, d):
    large = table(spark, d, "orders").filter(lambda c: c.o_totalprice > 400_000).dataframe()
    customers = table(spark, d, "customer").dataframe()
    both = customers.join(large, customers.c_custkey == large.o_custkey, "left")
    e = Entity("both", [Field(f.name, f.dataType, True) if f.name != "c_custkey" else Field(f.name, f.dataType) for f in both.schema.fields], ["c_custkey"], timestamps=False)
    c = Columns(e)
    return both.filter((c.o_orderkey == None) | (c.o_orderpriority != None)).select("c_custkey", c.o_orderkey.is_null().alias("no_order"))  # noqa: E711


_LIKE = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '{p}'"


@registered(f"SELECT c_custkey, c_mktsegment FROM customer WHERE {_LIKE.format(c='c_mktsegment', p='m_ch%')}")
def q08_like_ascii(spark, d):
    return table(spark, d, "customer").filter(lambda c: c.c_mktsegment.like("M_cH%")).select("c_custkey", "c_mktsegment").dataframe()


@registered(
    f"SELECT p_partkey, p_name FROM part WHERE ({_LIKE.format(c='p_name', p='small%')} OR {_LIKE.format(c='p_name', p='%ring')}) AND {_LIKE.format(c='p_type', p='%o%')}"
)
def q08_like_helpers(spark, d):
    q = table(spark, d, "part").filter(lambda c: c.p_name.has_prefix("SMALL") | c.p_name.has_suffix("Ring")).filter(lambda c: c.p_type.contains("o"))
    return q.select("p_partkey", "p_name").dataframe()


@registered("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderpriority = '1-URGENT')")
def q09_bool_logic(spark, d):
    return table(spark, d, "orders").filter(lambda c: ((c.o_orderstatus == "F") & (c.o_totalprice > 200_000)) | ~(c.o_orderpriority == "1-URGENT")).select("o_orderkey").dataframe()


@registered("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice < 50000")
def q10_chained_filter_or(spark, d):
    q = table(spark, d, "orders").filter(lambda c: (c.o_orderstatus == "F") | (c.o_orderstatus == "P")).filter(lambda c: c.o_totalprice < 50_000)
    return q.select("o_orderkey").dataframe()


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 17, 101, 998)")
def q11_id_in(spark, d):
    return table(spark, d, "orders").by_ids([3, 17, 101, 998]).select("o_orderkey", "o_totalprice").dataframe()


@registered("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE a.l_orderkey = 5979) OR (l_orderkey = 7124 AND l_linenumber = 7)")
def q11_composite_id(spark, d):
    wanted = [(5979, n) for n in range(1, 50)] + [(7124, 7)]
    return table(spark, d, "lineitem").by_ids(wanted).select("l_orderkey", "l_linenumber", "l_partkey").dataframe()


@registered("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderpriority LIKE '1%'")
def q11_raw_predicate(spark, d):
    return table(spark, d, "orders").filter(raw("o_totalprice > ? AND o_orderpriority LIKE ?", [250_000, "1%"])).select("o_orderkey").dataframe()


# Projection, order, paging


@registered("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def q12_select_n(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").dataframe()


@registered("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q13_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().dataframe()


@registered("SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def q13_distinct_count(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().dataframe().agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def q14_multi_order_paging(spark, d):
    q = table(spark, d, "orders").order("o_orderpriority").order_desc("o_totalprice").order("o_orderkey")
    return q.offset(100).limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice").dataframe()


# Aggregates

_AGG = """SELECT count(*) AS "count", round(sum(l_quantity), 4) AS total, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS lines,
  round(avg(l_extendedprice), 6) AS mean, min(l_shipdate)::VARCHAR AS first, max(l_returnflag) AS last FROM lineitem WHERE {}"""


def _aggregates(q):
    out = q.aggregate(count=True, total=("sum", "l_quantity"), lines=("sum", "l_linenumber"), mean=("avg", "l_extendedprice"), first=("min", "l_shipdate"), last=("max", "l_returnflag"))
    return out.select("count", F.round("total", 4).alias("total"), "lines", F.round("mean", 6).alias("mean"), F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "last")


@registered(_AGG.format("l_discount > 0.03"))
def q15_aggregates(spark, d):
    return _aggregates(table(spark, d, "lineitem").filter(lambda c: c.l_discount > 0.03).order("l_orderkey").limit(5))


@registered(_AGG.replace("round(sum(l_quantity), 4)", "coalesce(sum(l_quantity), 0.0)").format("l_quantity < 0"))
def q15_aggregates_empty(spark, d):
    return _aggregates(table(spark, d, "lineitem").filter(lambda c: c.l_quantity < 0))


@registered("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS large, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS negative")
def q16_exists(spark, d):
    orders = table(spark, d, "orders")

    def some(q):
        return q.filtered().limit(1).agg((F.count("*") > 0).alias("x"))

    one = some(orders.filter(lambda c: c.o_totalprice > 400_000)).select(F.lit(1).alias("k"), F.col("x").alias("large"))
    two = some(orders.filter(lambda c: c.o_totalprice < 0)).select(F.lit(1).alias("k"), F.col("x").alias("negative"))
    return one.join(two, "k").drop("k")


# Nested JSON


@registered("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') > '9'")
def q17_json_nested_text(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k")).filter(F.col("k") > "9")


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS props__k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 9")
def q17_json_nested_typed(spark, d):
    return table(spark, d, "events").filter(lambda c: c["props.k"] > 9).select("event_id", "props.k").dataframe()


@registered("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id")
def q25_json_array_text(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    docs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    return docs.select("conv_id", array_text(F.to_json(F.struct("turns")), "$.turns.text").alias("said"))


# Full text

_TOKENS = r"' ' || trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
_DOC = _TOKENS.format(c="text")


@registered(f"SELECT doc_id FROM documents WHERE contains({_DOC}, ' of the ')")
def q18_fts_phrase(spark, d):
    return table(spark, d, "documents").search(" of  THE", "documents_fts").select("doc_id").dataframe()


@registered(f"SELECT doc_id FROM documents WHERE contains({_DOC}, ' the ') AND (contains({_DOC}, ' was ') OR contains({_DOC}, ' which ')) AND NOT contains({_DOC}, ' from ')")
def q19_fts_boolean(spark, d):
    m = (fts.Term("the") & (fts.Term("was") | fts.Term("which"))) - fts.Term("from")
    return table(spark, d, "documents").matching(m, "documents_fts").select("doc_id").dataframe()


@registered(f"SELECT doc_id FROM documents WHERE contains({_DOC}, ' thing')")
def q20_fts_prefix(spark, d):
    return table(spark, d, "documents").matching(fts.Prefix("thing"), "documents_fts").select("doc_id").dataframe()


@registered(f"SELECT page_id FROM pages WHERE contains({_TOKENS.format(c='url')}, ' https ') AND contains({_TOKENS.format(c='html')}, ' nav ')")
def q21_fts_column(spark, d):
    m = fts.In(fts.Term("https"), ("url",)) & fts.In(fts.Term("nav"), ("html",))
    return table(spark, d, "pages").matching(m).select("page_id").dataframe()


@registered("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion,')")
def q22_fts_trigram(spark, d):
    return table(spark, d, "documents").search("TION,", "documents_sub").select("doc_id").dataframe()


_BM25 = rf"""
WITH t AS (SELECT doc_id, string_split(trim({_DOC}), ' ') AS w FROM documents),
f AS (SELECT doc_id, CASE WHEN w = [''] THEN 0 ELSE len(w) END AS dl, len(list_filter(w, lambda x: x = 'was')) AS a, len(list_filter(w, lambda x: x = 'from')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS mean, sum((a > 0)::INT) AS na, sum((b > 0)::INT) AS nb FROM f),
r AS (SELECT doc_id, a, b,
  -(greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean))
  + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean))) AS rank FROM f, s)
"""


@registered(_BM25 + "SELECT doc_id, round(rank, 9) AS rank FROM r WHERE a > 0 OR b > 0")
def q23_fts_bm25(spark, d):
    q = table(spark, d, "documents")
    m = fts.Term("was") | fts.Term("from")
    ranked = fts.with_rank(q.df, q.df, q.entity, m, "documents_fts")
    return ranked.filter("rank is not null").select("doc_id", F.round("rank", 9).alias("rank"))


@registered(_BM25 + "SELECT doc_id FROM r WHERE a > 0 OR b > 0 ORDER BY round(rank, 12), doc_id DESC LIMIT 40")
def q24_fts_rank_then_order(spark, d):
    m = fts.Term("was") | fts.Term("from")
    q = table(spark, d, "documents").matching(m, "documents_fts").order_by_rank(m, "documents_fts").order_desc("doc_id")
    return q.limit(40).select("doc_id").dataframe()


@registered(f"SELECT w AS term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest(string_split(trim({_DOC}), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def q24_postings_terms(spark, d):
    q = table(spark, d, "documents")
    posts = fts.postings(q.df, q.entity, "documents_fts")
    return posts.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)")
def q26_semi_join_key(spark, d):
    lines = table(spark, d, "lineitem").filter(lambda c: (c.l_returnflag == "R") & (c.l_quantity >= 49)).select("l_orderkey").dataframe()
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice").dataframe()
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_semi")


# Updates


@registered("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def q27_update_set(spark, d):
    q = table(spark, d, "orders").filter(lambda c: c.o_totalprice > 300_000).limit(3)
    return mut.update_all(q, {"o_orderstatus": "X", "o_totalprice": 0.0}).select("o_orderkey", "o_orderstatus", "o_totalprice")


@registered("SELECT p_partkey, CASE WHEN p_size >= 20 THEN p_size + 1 ELSE p_size END AS p_size, round(CASE WHEN p_size >= 20 THEN p_retailprice * 2 - p_size ELSE p_retailprice END, 4) AS p_retailprice FROM part")
def q28_update_incr(spark, d):
    q = table(spark, d, "part").filter(lambda c: c.p_size >= 20)
    new = mut.update_all(q, {"p_size": mut.Assign.plus(1), "p_retailprice": mut.Assign.sql("p_retailprice * ? - p_size", 2)})
    return new.select("p_partkey", "p_size", F.round("p_retailprice", 4).alias("p_retailprice"))


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT coalesce(nullif(l_returnflag, 'N') = 'R', false)")
def q29_delete_where(spark, d):
    q = table(spark, d, "lineitem").filter(F.expr("nullif(l_returnflag, 'N') = 'R'"))
    return mut.delete_all(q).select("l_orderkey", "l_linenumber", "l_quantity")


@registered(
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey NOT IN (3)
    UNION ALL SELECT c_custkey, c_name, c_nationkey, 0.0, c_mktsegment FROM customer WHERE c_nationkey = 3
    UNION ALL SELECT c_custkey + 1000000000, 'new', c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 4"""
)
def q30_upsert(spark, d):
    q = table(spark, d, "customer")
    changed = q.df.filter("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0))
    new = q.df.filter("c_nationkey = 4").withColumns({"c_custkey": F.col("c_custkey") + 1_000_000_000, "c_name": F.lit("new")})
    return mut.save(q.entity, q.df, changed.unionByName(new))


@registered(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN 1700000000 ELSE epoch(o_orderdate)::BIGINT END AS updated FROM orders"
)
def q31_touch_updated_at(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("status"), at.alias("created_at"), at.alias("updated_at"))
    e = Entity("order", [Field("o_orderkey", T.LongType()), Field("status", T.StringType(), True), Field("created_at", T.TimestampType()), Field("updated_at", T.TimestampType())], ["o_orderkey"])
    new = df.withColumn("status", F.when(F.col("status") == "F", "done").otherwise(F.col("status")))
    out = mut.touch_updated_at(df, new, e, F.timestamp_seconds(F.lit(1_700_000_000)))
    return out.select("o_orderkey", "status", F.unix_seconds("updated_at").alias("updated"))


# SQL


@registered(
    "WITH q AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000), p AS (SELECT * FROM q ORDER BY o_orderkey LIMIT 100 OFFSET 200) "
    "SELECT p.*, 3 AS page, (SELECT count(*) FROM q) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM q) / 100.0)) AS INTEGER) AS total_pages FROM p"
)
def q32_page_query(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("q32_orders")
    got = sqlapi.query_page(spark, "SELECT o_orderkey, o_totalprice FROM q32_orders WHERE o_totalprice > ? ORDER BY o_orderkey;", [200_000], page=3, size=100)
    rows = spark.createDataFrame(got.rows, "o_orderkey long, o_totalprice double")
    return rows.select("*", F.lit(got.page).alias("page"), F.lit(got.total).cast("long").alias("total"), F.lit(got.total_pages).alias("total_pages"))


# Change capture


@registered(
    """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'insert' WHEN c_nationkey = 5 THEN 'delete' ELSE 'update' END AS operation,
    CASE WHEN c_nationkey <> 5 THEN c_acctbal + (c_nationkey <> 7)::INT END AS c_acctbal FROM customer WHERE c_nationkey IN (5, 7) OR c_mktsegment = 'BUILDING'"""
)
def q33_snapshot_diff(spark, d):
    q = table(spark, d, "customer")
    old = q.df.filter("c_nationkey <> 7")
    raised = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") != 7)
    new = q.df.filter("c_nationkey <> 5").withColumn("c_acctbal", F.when(raised, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return cdc.snapshot_diff(q.entity, old, new).select("c_custkey", "operation", F.col("row.c_acctbal").alias("c_acctbal"))


_OPS = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"


@registered(
    f"""WITH e AS (SELECT event_id, user_id, {_OPS} AS op, value FROM events)
    SELECT user_id, CASE WHEN arg_min(op, event_id) = 'insert' AND arg_max(op, event_id) = 'update' THEN 'insert' ELSE arg_max(op, event_id) END AS operation,
    arg_max(value, event_id) AS value, max(event_id) AS seq, count(*) AS covered FROM e GROUP BY user_id"""
)
def q34_coalesce_ops(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("seq"), F.expr(_OPS).alias("operation"), "value")
    return cdc.coalesced(e, ["user_id"], payload="value")


@registered("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q35_lww_latest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value")
    return sync.latest(e, ("user_id",), "ts", "event_id").drop("ts")


@registered(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS sync_key, epoch_us(ts) // 1000 * 1000000 + event_id AS version_ms, event_type = 'error' AS deleted, CASE WHEN event_type <> 'error' THEN props END AS payload, event_type FROM events),
    a AS (SELECT * FROM e WHERE event_type IN ('signup', 'view') QUALIFY row_number() OVER (PARTITION BY sync_key ORDER BY version_ms DESC) = 1),
    b AS (SELECT * FROM e WHERE event_type NOT IN ('signup', 'view') QUALIFY row_number() OVER (PARTITION BY sync_key ORDER BY version_ms DESC) = 1)
    SELECT sync_key, version_ms, deleted, payload FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY sync_key ORDER BY version_ms DESC) = 1"""
)
def q36_tombstone_apply(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    dead = F.col("event_type") == "error"
    r = e.select(
        F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("sync_key"),
        (F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000 + F.col("event_id")).alias("version_ms"),
        dead.alias("deleted"),
        F.when(~dead, F.col("props")).alias("payload"),
        "event_type",
    )
    ours = r.filter(F.col("event_type").isin("signup", "view")).drop("event_type")
    theirs = r.filter(~F.col("event_type").isin("signup", "view")).drop("event_type")
    return sync.apply_changes(sync.latest(ours), theirs).drop("entity_type")


@registered("SELECT p_partkey, sha256('\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x04'::BLOB || 'part'::BLOB || encode(CAST(p_partkey AS VARCHAR))) AS record_name FROM part")
def q37_record_name(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", keys.record_name(F.lit("part"), F.encode(F.col("p_partkey").cast("string"), "UTF-8")).alias("record_name"))


_NOW = "CAST(floor(value * 100) AS BIGINT)"


@registered(
    f"""WITH e AS (SELECT event_id, user_id, {_NOW} AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT event_id, user_id, max(now - i) OVER (PARTITION BY user_id ORDER BY event_id) + i AS version FROM e"""
)
def q38_monotone_version(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.expr(_NOW).alias("now"))
    return cdc.monotone_versions(e, ["user_id"], "event_id", "now").drop("now")


@registered(
    f"""WITH e AS (SELECT event_id, user_id, {_NOW} AS now FROM events),
    l AS (SELECT event_id, user_id, greatest(max(now) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS lg FROM e)
    SELECT event_id, user_id, (lg * 65536) + ((row_number() OVER (PARTITION BY user_id, lg ORDER BY event_id) - (lg > 0)::INT) & 65535) AS clock FROM l"""
)
def q39_hybrid_clock(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.expr(_NOW).alias("now"))
    return cdc.hybrid_clock(e, ["user_id"], "event_id", "now").drop("now")


@registered("WITH h AS (SELECT min(event_id) AS hole FROM events WHERE value > 95) SELECT coalesce(max(event_id), 0) AS cursor FROM events, h WHERE hole IS NULL OR event_id < hole")
def q40_prefix_cursor(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    return sync.prefix_cursor(e, F.col("value") <= 95, "event_id")


@registered("SELECT doc_id, CASE WHEN length(base64(encode(coalesce(text, '')))) > 4000 THEN 'asset' ELSE 'inline' END AS place FROM documents")
def q41_envelope_split(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", sync.inline_or_asset(F.coalesce("text", F.lit("")), 4000).alias("place"))


@registered("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice BETWEEN 1000.5 AND 300000 GROUP BY o_orderstatus")
def q42_sql_params(spark, d):
    e = table(spark, d, "orders")
    e.df.createOrReplaceTempView("q42_orders")
    s = sqlapi.Sql("SELECT ").column("o_orderstatus", e.entity).text(", count(*) AS n, round(avg(").column("o_totalprice", e.entity).text("), 4) AS mean FROM ").table("q42_orders")
    s = s.text(" WHERE o_orderpriority <> ").value("5-LOW").text(" AND o_totalprice BETWEEN ").value(1000.5).text(" AND ").value(300_000)
    return s.text(" GROUP BY ").column("o_orderstatus").run(spark)


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>", "BOOLEAN": "boolean", "SMALLINT": "smallint", "TINYINT": "tinyint", "FLOAT": "float"}
_TYPE = "CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " ELSE data_type END"


@registered(
    f"""SELECT 'q43_' || table_name AS "table", column_name AS "column", CAST(ordinal_position - 1 AS INTEGER) AS position, {_TYPE} AS type, true AS nullable
    FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in KEYS)})"""
)
def q43_schema_catalog(spark, d):
    names = [r.name.removesuffix(".parquet") for r in files.listing(spark, d).filter(F.col("name").endswith(".parquet")).collect()]
    for t in names:
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"q43_{t}")
    return sqlapi.schema_of(spark).filter(F.col("table").isin([f"q43_{t}" for t in names]))


@registered(
    """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json,
    concat(n_nationkey, ',\"', n_name, ',\"\"x\"\"\",', n_regionkey) AS csv FROM nation"""
)
def q44_csv_json_encode(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    quoted = nation.withColumn("n_name", F.concat("n_name", F.lit(',"x"')))
    csv = quoted.select("n_nationkey", sqlapi.as_csv(quoted).alias("csv"))
    return nation.select("n_nationkey", sqlapi.as_json(nation).alias("json")).join(csv, "n_nationkey")


@registered()
def q45_file_listing(spark, d):
    return files.listing(spark, d).select("name", "is_directory", "size")


# Checks


@registered("SELECT 'unique' AS rule, 'c_mktsegment' AS detail, count(*) AS rows FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0")
def q46_constraints(spark, d):
    q = table(spark, d, "customer")
    e = Entity("customer", q.entity.fields, q.entity.key, unique=[("c_mktsegment",)], timestamps=False)
    return mut.violations(e, q.df)


@registered("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def q47_foreign_key(spark, d):
    lines = table(spark, d, "lineitem").dataframe()
    orders = table(spark, d, "orders").filter(lambda c: c.o_orderstatus != "P").dataframe()
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_anti").select("l_orderkey", "l_linenumber")


@registered(f"SELECT doc_id, len(list_filter(string_split(trim({_DOC}), ' '), lambda x: x <> '')) AS n_tokens FROM documents")
def q48_token_count(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", text.token_count(text.padded_tokens(F.col("text"))).cast("long").alias("n_tokens"))


# Logs

_LOG = f"SELECT event_id + 1 AS seq, 'event' AS entity_type, CAST(user_id AS VARCHAR) AS sync_key, {_OPS} AS operation, props AS payload, epoch_us(ts) // 1000 AS created_at FROM events"


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.lit("event").alias("entity_type"),
        F.col("user_id").cast("string").alias("sync_key"),
        F.expr(_OPS).alias("operation"),
        F.col("props").alias("payload"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"),
    )


@registered(f"SELECT seq, sync_key, operation FROM ({_LOG}) WHERE seq > 500 ORDER BY seq LIMIT 100")
def q49_changes_after(spark, d):
    return cdc.changes(_log(spark, d), 500, 100).select("seq", "sync_key", "operation")


@registered("SELECT max(event_id) + 1 AS last_seq, count(*) FILTER (event_id + 1 > 500) AS pending FROM events")
def q50_log_status(spark, d):
    return cdc.log_status(_log(spark, d), 500)


@registered("SELECT count(*) FILTER (event_id + 1 <= 700) AS completed, count(*) AS total FROM events")
def q51_progress(spark, d):
    return sync.progress(_log(spark, d), 700)


@registered(
    f"""WITH w AS (SELECT *, lag(created_at) OVER (ORDER BY seq) AS before FROM (SELECT * FROM ({_LOG}) WHERE seq > 500 ORDER BY seq LIMIT 200)),
    g AS (SELECT *, max((coalesce(created_at < before, false))::INT) OVER (ORDER BY seq) AS stop FROM w)
    SELECT sync_key, arg_max(operation, seq) AS operation, max(seq) AS seq, count(*) AS covered FROM g WHERE stop = 0 GROUP BY sync_key"""
)
def q52_upload_batch(spark, d):
    return sync.upload_batch(_log(spark, d), 500).select("sync_key", "operation", "seq", F.size("covered").cast("long").alias("covered"))


@registered("SELECT DISTINCT s.s_suppkey, p.p_brand FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey WHERE s.s_nationkey = 3")
def q53_relation_by_link_table(spark, d):
    suppliers = table(spark, d, "supplier").where("s_nationkey", equals=3).select("s_suppkey").dataframe()
    links = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().dataframe()
    parts = table(spark, d, "part").select("p_partkey", "p_brand").dataframe()
    return links.join(suppliers, links.l_suppkey == suppliers.s_suppkey).join(parts, links.l_partkey == parts.p_partkey).select("s_suppkey", "p_brand").distinct()


#: Words with the stem "thing".
_THINGS = "thing(s|e|es|ed|eds|ing|ings|ful|fuls|ness|nesses|fulness|fully)?"


@registered(f"SELECT doc_id FROM documents WHERE regexp_matches({_DOC}, ' {_THINGS} ')")
def q54_fts_porter(spark, d):
    return table(spark, d, "documents").search("things", "documents_stem").select("doc_id").dataframe()


@registered(_BM25.replace("x = 'was'", "starts_with(x, 'thing')") + "SELECT doc_id, round(rank, 9) AS rank FROM r WHERE a > 0 OR b > 0")
def q55_fts_prefix_rank(spark, d):
    q = table(spark, d, "documents")
    ranked = fts.with_rank(q.df, q.df, q.entity, fts.Prefix("thing") | fts.Term("from"), "documents_fts")
    return ranked.filter("rank is not null").select("doc_id", F.round("rank", 9).alias("rank"))


@registered(_BM25 + "SELECT doc_id, round(rank, 9) AS rank FROM r WHERE a > 0 OR b > 0")
def q56_fts_index_bm25(spark, d):
    q = table(spark, d, "documents")
    posts, lengths = fts.postings(q.df, q.entity, "documents_fts"), fts.row_lengths(q.df, q.entity, "documents_fts")
    found = fts.find(posts, lengths, q.entity, fts.Term("was") | fts.Term("from"), "documents_fts")
    return found.select("doc_id", F.round("rank", 9).alias("rank"))


@registered(f"SELECT doc_id FROM documents WHERE (contains({_DOC}, ' of the ') OR contains({_DOC}, ' thing')) AND NOT contains({_DOC}, ' from ')")
def q57_fts_match_text(spark, d):
    m = match_text.parse('("of the" OR text: thing*) NOT from', ["text"])
    return table(spark, d, "documents").matching(m, "documents_fts").select("doc_id").dataframe()


# Rows by key


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'NEW', n_regionkey FROM nation WHERE n_regionkey = 1")
def q58_insert(spark, d):
    q = table(spark, d, "nation")
    new = q.df.filter("n_regionkey = 1").withColumns({"n_nationkey": F.col("n_nationkey") + 100, "n_name": F.lit("NEW")})
    return mut.insert(q.entity, q.df, new)


@registered("SELECT s_suppkey, s_nationkey, round(CASE WHEN s_nationkey = 3 THEN -s_acctbal ELSE s_acctbal END, 4) AS s_acctbal FROM supplier WHERE s_nationkey <> 4")
def q59_update_and_delete_rows(spark, d):
    q = table(spark, d, "supplier")
    turned = q.df.filter("s_nationkey = 3").withColumn("s_acctbal", -F.col("s_acctbal"))
    new = mut.delete(q.entity, mut.update(q.entity, q.df, turned), q.df.filter("s_nationkey = 4").select("s_suppkey"))
    return new.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 4).alias("s_acctbal"))


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 5) ORDER BY n_nationkey % 2, n_nationkey DESC")
def q60_where_in_order_sql(spark, d):
    q = table(spark, d, "nation").where("n_nationkey", is_in=[3, 5, 99])
    return q.order_sql("n_nationkey % 2").order_sql("n_nationkey", ascending=False).select("n_nationkey", "n_name").dataframe()


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def q61_by_id(spark, d):
    return table(spark, d, "nation").by_id(7).select("n_nationkey", "n_name").dataframe()


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS note FROM events")
def q62_decode_with_defaults(spark, d):
    e = Entity("event", [Field("event_id", T.LongType()), Field("k", T.LongType(), True), Field("note", T.StringType(), default="none")], ["event_id"], timestamps=False)
    doc = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(","), F.substring("props", 2, 1 << 20))
    return e.from_json(spark.read.parquet(f"{d}/events.parquet").select(doc.alias("j")), "j")


# Logs and records


@registered("SELECT c_custkey, 'insert' AS operation, c_acctbal FROM customer WHERE c_nationkey <> 5")
def q63_bootstrap(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet").withColumn("updated_at", F.lit(0).cast("timestamp"))
    fields = [Field(f.name, f.dataType, f.name != "c_custkey") for f in df.schema.fields]
    made = cdc.bootstrap_events(df, Entity("customer", fields, ["c_custkey"], timestamps=False), df.filter("c_nationkey = 5"))
    return made.select("c_custkey", "operation", F.col("row.c_acctbal").alias("c_acctbal"))


def _records(spark, d, where, version):
    e = spark.read.parquet(f"{d}/events.parquet").filter(where)
    key = F.concat(F.col("user_id"), F.lit(":"), F.col("event_type"))
    newest = e.groupBy(key.alias("sync_key")).agg(F.max("event_id").alias("event_id"), F.max_by("props", "event_id").alias("payload"))
    return newest.select(F.lit("event").alias("entity_type"), "sync_key", F.expr(version).alias("version_ms"), F.lit(False).alias("deleted"), "payload")


_RECORDS = "SELECT user_id || ':' || event_type AS sync_key, max(event_id) AS event_id, arg_max(props, event_id) AS payload FROM events WHERE {} GROUP BY 1"


@registered(
    f"""WITH s AS (SELECT *, event_id % 7 AS v FROM ({_RECORDS.format("user_id % 3 <> 0")})), n AS (SELECT *, event_id % 5 AS v FROM ({_RECORDS.format("user_id % 2 = 0")}))
    SELECT n.sync_key, CASE WHEN s.v IS NULL OR n.v > s.v THEN 'apply' WHEN n.v < s.v THEN 'stale' ELSE 'same' END AS effect FROM n LEFT JOIN s ON n.sync_key = s.sync_key"""
)
def q64_effects(spark, d):
    state = _records(spark, d, "user_id % 3 <> 0", "event_id % 7")
    return sync.effects(state, _records(spark, d, "user_id % 2 = 0", "event_id % 5")).select("sync_key", "effect")


@registered(f"SELECT sync_key, event_id AS version_ms FROM ({_RECORDS.format('user_id % 2 = 0')})")
def q65_checked_page(spark, d):
    page = _records(spark, d, "user_id % 2 = 0", "event_id").withColumn("schema_version", F.lit(3))
    local = page.limit(0).withColumn("entity_type", F.lit("draft")).unionByName(page.withColumns({"entity_type": F.lit("draft"), "payload": F.lit("no json")}))
    return sync.check_page(page.unionByName(local), 3, ("draft",)).select("sync_key", "version_ms")


@registered(
    f"""WITH b AS (SELECT sync_key, max(seq) AS seq FROM ({_LOG}) WHERE seq <= 300 GROUP BY 1), r AS (SELECT sync_key, min(seq) AS seq FROM ({_LOG}) WHERE seq <= 600 GROUP BY 1)
    SELECT r.sync_key, r.seq, CASE WHEN b.seq IS NULL THEN 'not in the batch' ELSE 'older than what was sent' END AS reason FROM r LEFT JOIN b USING (sync_key) WHERE b.seq IS NULL OR r.seq < b.seq"""
)
def q66_receipts(spark, d):
    log = _log(spark, d)
    sent = log.filter("seq <= 300").groupBy("entity_type", "sync_key").agg(F.max("seq").alias("seq"))
    got = log.filter("seq <= 600").groupBy("entity_type", "sync_key").agg(F.min("seq").alias("seq"))
    return sync.check_receipts(sent, got).select("sync_key", "seq", "reason")


@registered(f"SELECT seq, CAST(CASE WHEN operation = 'delete' OR seq % 3 = 0 THEN created_at ELSE seq + 0.5 END AS DOUBLE) AS at FROM ({_LOG})")
def q67_effective_time(spark, d):
    said = F.when(F.col("seq") % 3 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"updated_at": '), F.col("seq"), F.lit(".5}")))
    return _log(spark, d).select("seq", cdc.effective_time(F.col("operation"), said, F.col("created_at").cast("double")).alias("at"))


@registered(
    """SELECT l_orderkey, l_linenumber, '02' || '01' || array_to_string(list_transform(range(8), lambda i: printf('%02X', (l_orderkey >> CAST(8 * i AS BIGINT)) & 255)), '')
    || '01' || array_to_string(list_transform(range(8), lambda i: printf('%02X', (CAST(l_linenumber AS BIGINT) >> CAST(8 * i AS BIGINT)) & 255)), '') AS key FROM lineitem WHERE l_quantity > 45"""
)
def q68_key_bytes(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity > 45")
    return lines.select("l_orderkey", "l_linenumber", F.hex(keys.key_bytes(F.col("l_orderkey"), F.col("l_linenumber"))).alias("key"))


# Schemas


@registered("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note, CAST(5 AS BIGINT) AS nations FROM region")
def q69_migrations(spark, d):
    region = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name")
    first = T.StructType(region.schema.fields)
    second = T.StructType([*first.fields, T.StructField("note", T.StringType())])
    third = T.StructType([*second.fields, T.StructField("nations", T.LongType(), False)])
    steps = [
        versions.Migration("001_regions", {"region": first}, lambda t: {"region": region}),
        versions.Migration("002_note", {"region": second}, lambda t: {"region": t["region"].withColumn("note", F.lit(None).cast("string"))}),
        versions.Migration("003_nations", {"region": third}, lambda t: {"region": t["region"].withColumn("nations", F.lit(5).cast("long"))}),
    ]
    tables, history = versions.migrate({"region": region}, steps, versions.adopt({"region": region}, steps[0], []))
    if history != [s.name for s in versions.pending(steps, [])] or versions.drift(third_schema := {"region": third}, tables, nullability=True):
        raise AssertionError(f"{history} doesn't end in {third_schema}")
    return tables["region"]


def queries() -> dict[str, Maker]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
