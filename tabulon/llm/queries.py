"""The registered queries of the operators of this subpackage, and their SQL where SQL can express them.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import chat_format, exact_dedup, jaccard_join, mixing, repetition, simple8b, sp_nbest, toxicity, unigram_count, warc
from tabulon.llm._store import new_path


def tokenizer_file(name: str) -> str:
    """Where the box keeps its public tokenizers; elsewhere pass other paths to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_chats(chat_format.as_records(turns))).withColumnRenamed("id", "conv_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), n=3, threshold=0.9)


def op5_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(_read(spark, sf_dir, "documents"), n=3, threshold=0.9)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "op6-archives")
    warc.write_pages(_read(spark, sf_dir, "pages"), to)
    found = warc.read_archives(spark, to, payloads=False)
    lost = F.concat_ws(" ", F.lit("op6 can't read back what it wrote:"), "file", F.lit("at"), F.col("start").cast("string"), "gap")
    found = found.filter(F.assert_true(F.col("gap").isNull(), lost).isNull())

    def page(column: str):
        number = F.regexp_extract(column, warc.ID_PREFIX + "([-0-9]+)>", 1)
        return F.when(number != "", number.cast("long"))

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_nbest.encode(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), full=False)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "op10-files")
    simple8b.write_token_files(_read(spark, sf_dir, "documents"), to, tokenizer_file("byte_bpe_50k.json"), added=True)
    return simple8b.read_token_files(spark, to)


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

def _escaped_length(column: str) -> str:
    """Characters of a text with an escape before each escape and control string."""
    found = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROLS)
    return f"(length({column}) + length({column}) - length(replace({column}, '\\', '')) + {found})"


_MARKS = " ".join(f"WHEN '{role}' THEN {len(a + b)}" for role, (a, b) in chat_format.ROLES.items())

OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    {len(chat_format.START)} + sum({_escaped_length('text')} + CASE role {_MARKS}
      ELSE {len(chat_format.TURN + chat_format.TEXT + chat_format.END)} + {_escaped_length('role')} END) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS tok FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""

OP5_LINKS_SQL = OP5_SQL.rsplit("\nSELECT s.doc_id", 1)[0] + r""",
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM links GROUP BY x),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS class_id FROM s WHERE len(sh) > 0)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, coalesce(e.class_id, s.doc_id) AS class_id,
       CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM s JOIN c ON c.x = s.doc_id LEFT JOIN k ON k.x = s.doc_id LEFT JOIN e ON e.doc_id = s.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_repetition, op2_exact_dedup, op3_toxicity, op4_chat_format, op5_jaccard_join, op5_jaccard_links, op6_warc, op7_mixing, op8_token_counts, op9_sentencepiece, op10_token_files)
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_repetition": repetition.repetition_sql(), "op2_exact_dedup": OP2_SQL, "op4_chat_format": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op5_jaccard_links": OP5_LINKS_SQL, "op6_warc": OP6_SQL, "op7_mixing": mixing.mix_sql()}
