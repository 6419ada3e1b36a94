"""Change capture: the events between two snapshots, and their versions and clocks.

Everything is a function of DataFrames. Versions and clocks, which the usual implementations keep
in a loop, have closed forms over windows by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.schema import Entity

LOGICAL_BITS = 16


def snapshot_diff(entity: Entity, old: DataFrame, new: DataFrame) -> DataFrame:
    """(key columns, operation, row, old_row) of what was inserted, updated and deleted.

    Rows that differ in updated_at alone don't count as updated. A changed key is a delete and an
    insert.
    """
    columns = entity.stored_columns
    compared = [c for c in columns if c != "updated_at"]
    a = old.select(*[F.col(f"`{k}`").alias(f"_a{i}") for i, k in enumerate(entity.key)], F.struct(*columns).alias("old_row"), F.struct(*compared).alias("_was"))
    b = new.select(*[F.col(f"`{k}`").alias(f"_b{i}") for i, k in enumerate(entity.key)], F.struct(*columns).alias("row"), F.struct(*compared).alias("_is"))
    both = a.join(b, [a[f"_a{i}"] == b[f"_b{i}"] for i in range(len(entity.key))], "full_outer")
    kind = F.when(F.col("old_row").isNull(), "insert").when(F.col("row").isNull(), "delete").when(~F.col("_was").eqNullSafe(F.col("_is")), "update")
    keys = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(entity.key)]
    return both.select(*keys, kind.alias("operation"), "row", "old_row").filter("operation is not null")


def coalesced(events: DataFrame, keys: list[str], seq: str = "seq", operation: str = "operation", payload: str = "row") -> DataFrame:
    """The events of each key as one: (keys, operation, payload, seq, covered).

    The last operation and payload hold; an insert followed by updates is an insert, and an
    insert that is deleted in the end is a delete.
    """
    first, last = F.min_by(operation, seq), F.max_by(operation, seq)
    return events.groupBy(*keys).agg(
        F.when((first == "insert") & (last == "update"), "insert").otherwise(last).alias(operation),
        F.max_by(payload, seq).alias(payload),
        F.max(seq).alias(seq),
        F.count("*").alias("covered"),
    )


def monotone_versions(events: DataFrame, keys: list[str], seq: str, now: str, known: Column | None = None) -> DataFrame:
    """``events`` with ``version``: at each event max(now, the key's last version + 1).

    With i the number of the event in its key, the version is i plus the largest now - i so far;
    ``known`` is a version from before.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    i = F.row_number().over(w).cast("long")
    out = events.withColumn("_i", i)
    version = F.max(F.col(now) - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")
    if known is not None:
        version = F.greatest(version, known + F.col("_i"))
    return out.withColumn("version", version).drop("_i")


def hybrid_clock(events: DataFrame, keys: list[str], seq: str, now: str) -> DataFrame:
    """``events`` with ``clock``: 48 bits of the latest time so far, 16 bits that count its events."""
    w = Window.partitionBy(*keys).orderBy(seq)
    latest = F.greatest(F.max(now).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast("long"))
    out = events.withColumn("_latest", latest)
    nth = F.row_number().over(Window.partitionBy(*keys, "_latest").orderBy(seq))
    count = nth - F.when(F.col("_latest") > 0, 1).otherwise(0)
    value = F.shiftleft(F.col("_latest"), LOGICAL_BITS).bitwiseOR(count.bitwiseAND(F.lit((1 << LOGICAL_BITS) - 1)).cast("long"))
    return out.withColumn("clock", value).drop("_latest")


def bootstrap_events(rows: DataFrame, entity: Entity, logged: DataFrame) -> DataFrame:
    """Insert events of the rows whose keys the log doesn't have, with their own timestamps."""
    new = rows.join(logged.select(*entity.key).distinct(), list(entity.key), "left_anti")
    return new.select(*entity.key, F.lit("insert").alias("operation"), F.struct(*entity.stored_columns).alias("row"), F.col("updated_at").alias("at"))


def log_status(log: DataFrame, after: int) -> DataFrame:
    """(last_seq, pending): the log's last number, and how many come after ``after``."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"), F.count(F.when(F.col("seq") > after, 1)).alias("pending"))


def changes(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The next events of a log in ascending order."""
    return log.filter(F.col("seq") > after).orderBy("seq").limit(limit)


def effective_time(operation: Column, payload: Column, created_at: Column) -> Column:
    """When a record was updated: as its payload says; of a delete, or an unreadable payload, when it was logged."""
    said = F.try_to_number(F.get_json_object(payload, "$.updated_at"), F.lit("99999999999999.999999"))
    return F.coalesce(F.when(operation != "delete", said.cast("double")), created_at)
