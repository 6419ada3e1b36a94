"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm._store import Scratch


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link every neighbour of u that is larger (large-star) or not larger (small-star) to u's least one."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(flipped) if both else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = near.join(least, "a")
    if both:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("root")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("root").alias("root"))
    return per_node.filter("own > 1 or (own = 1 and root = 1)").isEmpty()


def connected_components(work: Scratch, edges: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, component) for each node on an edge; the component is its smallest node.

    Self-links and repeated links are allowed; links with a null end are ignored. Every round is
    written to ``work``; nothing about nodes or links comes to the driver but whether they are
    settled: each node linked to its component's least one and to no other.
    """
    cur = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    for _ in range(rounds):
        cur = work.saved(_star(_star(cur, True), False), "links")
        if _settled(cur):
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
