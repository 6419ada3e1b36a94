"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted into
integer names; then adjacent names are paired, the distinct pairs are sorted into integer names
in turn, and so on until each document has a single name. Two documents get the same name at the
same level exactly when their normalised texts are equal.

Scale: the text is shuffled once, as distinct blocks that each task has deduplicated before.
Everything after that moves integers. Blocks are routed by a 64-bit hash; a hash that stands for
two different blocks is found and its blocks are named by their text, so a collision of the hash
can't join different texts. Copies are reduced to distinct blocks and pairs before naming; the
joins back to the occurrences read both sides from shuffles, which Spark splits where they're skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.llm._store import Scratch

#: Buckets in which names are sorted, or more, of so many rows on average. A name is the bucket and the rank in it.
NAME_BUCKETS = 1 << 12
BUCKET_ROWS = 1 << 20
RANK_BITS = 40


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _blocks(norm: Column, size: int) -> Column:
    return F.when(F.octet_length(norm) <= size, F.array(norm)).otherwise(
        F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % size), F.lit(0))
    )


def _named(df: DataFrame, hashed: Column, order: list[str], rows: int) -> DataFrame:
    """``df``, of up to so many distinct rows, with ``name``: its bucket and its rank in the sorted bucket."""
    bucket = F.pmod(hashed, F.lit(max(NAME_BUCKETS, rows // BUCKET_ROWS)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    name = F.shiftleft(F.col("_bucket").cast("long"), RANK_BITS) + rank
    return df.withColumn("_bucket", bucket).withColumn("name", name).drop("_bucket")


def exact_dedup(docs: DataFrame, block_chars: int = 8192, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; all empty texts are equal. Of equal texts the smallest doc_id
    stays; null ids come last, and are kept only in groups without any other id. Rows that repeat
    a doc_id and a text are one document: they have the same ``kept`` and each counts in
    ``group_size``. Rows that share a doc_id but not the text are told apart. Other columns of
    ``docs`` are not read. An empty table gives an empty result.

    ``hash_bits`` narrows the routing hash; it exists to test the path for colliding hashes.
    """
    def hashed(block: Column) -> Column:
        h = F.xxhash64(block)
        return h if hash_bits == 64 else F.pmod(h, F.lit(1 << hash_bits))

    work = Scratch(docs.sparkSession, "op2")
    norm = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_norm"))
    cut = norm.select("doc_id", F.sha2("_norm", 256).alias("sha"), _blocks(F.col("_norm"), block_chars).alias("_b"))
    blocks = cut.select("doc_id", "sha", F.size("_b").alias("n"), F.posexplode("_b").alias("pos", "block"))
    occ = work.saved(blocks.select("doc_id", "sha", "n", "pos", hashed(F.col("block")).alias("h")), "occurrences")
    total, most = occ.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()

    text_only = norm.select(F.explode(_blocks(F.col("_norm"), block_chars)).alias("block"))
    distinct = text_only.select(hashed(F.col("block")).alias("h"), "block").distinct()
    per_hash = work.saved(_named(distinct.groupBy("h").agg(F.count("*").alias("texts")), F.col("h"), ["h"], total), "names")
    named = occ.join(per_hash.filter("texts = 1").select("h", "name"), "h", "left")
    clash = per_hash.filter("texts > 1").select("h")
    if not clash.isEmpty():
        named = _by_text(named, blocks, distinct, clash, hashed, total)
    cur = work.saved(named.select("doc_id", "sha", "n", "pos", "name"), "level0")

    heads = cur.filter("pos = 0 and n > 1").select("doc_id", "sha")
    single = cur.filter("n = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name")
    level, done, open_ = 0, [], cur.filter("n > 1").select("doc_id", "sha", "n", "pos", "name")
    while most > 1:
        level += 1
        even = F.pmod(F.col("pos"), F.lit(2)) == 0
        pairs = open_.groupBy("doc_id", "sha", "n", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("r")
        )
        names = _named(pairs.select("l", "r").distinct(), F.xxhash64("l", "r"), ["l", "r"], total)
        half = F.ceil(F.col("n") / 2).cast("int")
        here = work.saved(pairs.join(names, ["l", "r"]).select("doc_id", "sha", half.alias("n"), F.col("at").alias("pos"), "name"), f"level{level}")
        done.append(here.filter("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        open_ = here.filter("n > 1")
        most = (most + 1) // 2
    rows = single
    if done:
        ids = done[0]
        for d in done[1:]:
            ids = ids.unionByName(d)
        ids = ids.select(F.col("doc_id").alias("_d"), F.col("sha").alias("_s"), "level", "name")
        many = heads.join(ids, heads.doc_id.eqNullSafe(ids._d) & (heads.sha == ids._s)).select("doc_id", "sha", "level", "name")
        rows = single.unionByName(many)
    rows = work.saved(rows, "identities")
    groups = work.saved(rows.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = rows.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return work.result(out, "op2-documents")


def _by_text(named: DataFrame, blocks: DataFrame, distinct: DataFrame, clash: DataFrame, hashed, total: int) -> DataFrame:
    """Names by text for the blocks whose hash stands for several texts. They are below zero."""
    own = _named(distinct.join(clash, "h", "left_semi"), F.col("h"), ["h", "block"], total)
    own = own.select("h", "block", (-F.col("name")).alias("name"))
    again = blocks.withColumn("h", hashed(F.col("block"))).join(clash, "h", "left_semi")
    by_text = again.join(own, ["h", "block"]).select("doc_id", "sha", "n", "pos", "name")
    return named.filter(F.col("name").isNotNull()).select("doc_id", "sha", "n", "pos", "name").unionByName(by_text)


def keep_one(docs: DataFrame, block_chars: int = 8192) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document stays."""
    kept = exact_dedup(docs, block_chars).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (F.sha2(normalised(docs["text"]), 256) == kept["_kept_sha"])
    return docs.join(kept, same, "left_semi")
