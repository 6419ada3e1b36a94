"""Last-writer-wins synchronisation of keyed records, in batches and in Structured Streaming.

State is a table (entity_type, sync_key, version_ms, deleted, payload); tombstones stay in it for
good, and there is no watermark: an older version loses however late it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tabulon.errors import SyncError

KEY = ("entity_type", "sync_key")
MOST_IN_BATCH = 200
INLINE_LIMIT = 700_000
#: The most a retry waits, in seconds.
MOST_DELAY = 60.0


def latest(changes: DataFrame, keys: tuple[str, ...] = KEY, version: str = "version_ms", order: str | None = None) -> DataFrame:
    """The change of each key with the highest version; of equal versions the one later in ``order``."""
    by = F.struct(version, order) if order else F.col(version)
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_l")).select(*keys, "_l.*")


def same_content(a: Column, b: Column) -> Column:
    """JSON texts that are equal as values, whatever the order of their fields."""
    return F.try_parse_json(a).cast("string").eqNullSafe(F.try_parse_json(b).cast("string"))


def apply_changes(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """The state after a batch of remote changes: a newer one, or an equally new one, wins.

    Both have the columns entity_type, sync_key, version_ms, deleted and payload. A delete keeps
    its version, so that older changes can't bring the record back.
    """
    new = latest(incoming)
    old = state.select(*[F.col(c).alias(f"_o_{c}") for c in state.columns])
    both = old.join(new, [old[f"_o_{k}"] == new[k] for k in KEY], "full_outer")
    wins = F.col("version_ms").isNotNull() & (F.col("_o_version_ms").isNull() | (F.col("version_ms") >= F.col("_o_version_ms")))
    rest = [c for c in state.columns if c not in KEY]
    return both.select(*[F.coalesce(k, f"_o_{k}").alias(k) for k in KEY], *[F.when(wins, F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in rest])


def effects(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, effect) of each incoming record: apply, stale, or same for equal content at an equal version."""
    new = latest(incoming).alias("n")
    both = new.join(state.alias("s"), list(KEY), "left")
    newer, equal = F.col("n.version_ms") > F.col("s.version_ms"), F.col("n.version_ms") == F.col("s.version_ms")
    unchanged = (F.col("n.deleted") == F.col("s.deleted")) & (F.col("n.deleted") | same_content(F.col("n.payload"), F.col("s.payload")))
    effect = F.when(F.col("s.version_ms").isNull() | newer, "apply").when(~equal, "stale").when(unchanged, "same").otherwise("apply")
    return both.select(*KEY, effect.alias("effect"))


def live(state: DataFrame) -> DataFrame:
    """The records that aren't deleted."""
    return state.filter(~F.col("deleted"))


def check_page(incoming: DataFrame, schema_version: int, local_only: tuple[str, ...] = ()) -> DataFrame:
    """``incoming`` without local-only entities, or an error if one record of it is invalid.

    A page is applied whole or not at all: a null key or version, a live record without a JSON
    payload, or a record of a later schema stops it.
    """
    page = incoming.filter(~F.col("entity_type").isin(list(local_only))) if local_only else incoming
    bad = F.col("sync_key").isNull() | F.col("entity_type").isNull() | F.col("version_ms").isNull()
    bad = bad | (~F.col("deleted") & F.try_parse_json("payload").isNull())
    row = page.agg(F.count(F.when(bad, 1)).alias("bad"), F.max("schema_version").alias("newest")).first()
    if row.bad:
        raise SyncError(f"{row.bad} invalid records in the page")
    if row.newest is not None and row.newest > schema_version:
        raise SyncError(f"a record has schema {row.newest}; this is {schema_version}")
    return page


def upload_batch(log: DataFrame, cursor: int, size: int = MOST_IN_BATCH, local_only: tuple[str, ...] = ()) -> DataFrame:
    """The next records to send: (entity_type, sync_key, operation, payload, seq, covered).

    Of the next ``size`` events after the cursor, those before the first invalid one, or before
    one whose time goes back, reduced to the last event of each key with all the numbers it covers.
    """
    if not 1 <= size <= MOST_IN_BATCH:
        raise ValueError(f"a batch has 1 to {MOST_IN_BATCH} events")
    window = log.filter(F.col("seq") > cursor).orderBy("seq").limit(size)
    w = Window.partitionBy(F.lit(1)).orderBy("seq")  # at most `size` rows
    back = F.col("created_at") < F.lag("created_at").over(w)
    bad = F.col("sync_key").isNull() | ((F.col("operation") != "delete") & F.try_parse_json("payload").isNull()) | F.coalesce(back, F.lit(False))
    stopped = F.max(bad.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    good = window.withColumn("_stop", stopped).filter("_stop = 0")
    sent = good.filter(~F.col("entity_type").isin(list(local_only))) if local_only else good
    return sent.groupBy(*KEY).agg(
        F.max_by("operation", "seq").alias("operation"), F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"), F.sort_array(F.collect_list("seq")).alias("covered")
    )


def prefix_cursor(events: DataFrame, done: Column, seq: str = "seq") -> DataFrame:
    """(cursor): the last number before the first event that isn't done; 0 if there is none. Gaps don't matter."""
    hole = F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(seq)))
    both = events.agg(hole.alias("hole"), F.collect_set(F.lit(0)).alias("_"))
    first = both.first().hole
    before = events if first is None else events.filter(F.col(seq) < first)
    return before.agg(F.coalesce(F.max(seq), F.lit(0)).alias("cursor"))


def check_receipts(batch: DataFrame, receipts: DataFrame) -> DataFrame:
    """The receipts that don't fit the batch, with the reason: none means all is confirmed."""
    b = batch.select(*KEY, F.col("seq").alias("_sent"))
    both = receipts.join(b, list(KEY), "left")
    why = F.when(F.col("_sent").isNull(), "not in the batch").when(F.col("seq") < F.col("_sent"), "older than what was sent")
    return both.withColumn("reason", why).filter("reason is not null").drop("_sent")


def inline_or_asset(payload: Column, limit: int = INLINE_LIMIT) -> Column:
    """'asset' for a payload whose base64 is longer than the limit, else 'inline'."""
    base64_length = F.ceil(F.octet_length(payload) / 3) * 4
    return F.when(base64_length > limit, "asset").otherwise("inline")


def progress(log: DataFrame, cursor: int) -> DataFrame:
    """(completed, total) events of a log by the cursor."""
    return log.agg(F.count(F.when(F.col("seq") <= cursor, 1)).alias("completed"), F.count("*").alias("total"))


def retry_delay(attempt: int, server_hint: float = 0.0) -> float:
    """Seconds to wait before a retry: the server's hint, or 2^attempt up to a minute."""
    return max(server_hint, min(MOST_DELAY, 2.0**attempt))


def sync_stream(changes: DataFrame, read_state: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, schema_version: int) -> StreamingQuery:
    """Apply a stream of changes to the state, page by page, until what is there now is done.

    ``read_state`` gives the current state, ``publish`` stores the next one for a batch number. A
    page that is retried gives the same state, since applying a change twice is applying it once.
    """

    def page(batch: DataFrame, number: int) -> None:
        publish(apply_changes(read_state(), check_page(batch, schema_version).drop("schema_version")), number)

    return changes.writeStream.foreachBatch(page).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
