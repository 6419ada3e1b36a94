"""The driver's tables as read-only entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.operators.query import Query, query
from tabulon.schema import Entity, Field, FullTextIndex, Nested


def declared(spark: SparkSession, sf_dir: str, table: str, key: tuple[str, ...], **more) -> tuple[Entity, DataFrame]:
    """An entity with the columns that the table has, and the table."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    fields = [Field(f.name, f.dataType, nullable=f.name not in key) for f in df.schema.fields]
    return Entity(table, fields, key, **{"timestamps": False} | more), df


KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",),
}
MORE = {
    "documents": {"indexes": (FullTextIndex(("text",)), FullTextIndex(("text",), "documents_sub", "trigram"), FullTextIndex(("text",), "documents_stem", "porter"))},
    "pages": {"indexes": (FullTextIndex(("url", "html")),)},
    "events": {"nested": (Nested("props.k", T.IntegerType()),)},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> Query:
    """A query over all rows of a table."""
    return query(*declared(spark, sf_dir, name, KEYS[name], **MORE.get(name, {})))
