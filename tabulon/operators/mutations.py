"""Updates, deletes and upserts as functions from a snapshot to the next one.

Nothing is written here: each function returns the new snapshot, lazily, and ``affected`` counts
what a predicate hits. ``plans.versions`` publishes snapshots.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import ConstraintViolation, EntityNotFound, ReadOnlyViolation
from tabulon.operators.predicates import Ref, key_equals, raw
from tabulon.operators.query import Query
from tabulon.schema import Entity


class Assign:
    """What an update sets a column to."""

    @staticmethod
    def value(v: object) -> object:
        return v

    @staticmethod
    def sql(text: str, *values: object) -> Column:
        """An expression over the old row, with a place for each value."""
        return raw(text, values)

    @staticmethod
    def plus(n: float) -> _Step:
        return _Step(n)

    @staticmethod
    def minus(n: float) -> _Step:
        return _Step(-n)


class _Step:
    def __init__(self, n: float):
        self.n = n


def _writable(entity: Entity) -> None:
    if entity.readonly:
        raise ReadOnlyViolation(entity.table)


def _marked(query: Query) -> tuple[DataFrame, Column]:
    """The snapshot with a column that is true for the rows the query hits. Order and limits don't count."""
    if query.key_lists or query.matches:
        keys = list(query.entity.key)
        hit = query.filtered().select(*[F.col(f"`{k}`").alias(f"_hit_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
        on = [query.df[k].eqNullSafe(hit[f"_hit_{k}"]) for k in keys]
        return query.df.join(hit, on, "left").drop(*[f"_hit_{k}" for k in keys]), F.coalesce(F.col("_hit"), F.lit(False))
    p = F.lit(True)
    for x in query.predicates:
        p = p & x
    return query.df, F.coalesce(p, F.lit(False))


def update_all(query: Query, values: Mapping[str, object], now: Column | None = None) -> DataFrame:
    """The snapshot with the columns set where the predicate is true. All see the old row.

    Where ``updated_at`` isn't among the values, rows that are hit get ``now`` in it.
    """
    _writable(query.entity)
    sets: dict[str, Column] = {}
    for prop, v in values.items():
        c = query.entity.column(prop)
        old = F.col(f"`{c}`")
        if isinstance(v, _Step):
            new = old + F.lit(v.n)
        elif isinstance(v, Ref):
            new = v.column
        else:
            new = v if isinstance(v, Column) else F.lit(v)
        sets[c] = new
    stored = query.entity.stored_columns
    if not sets:
        return query.df.select(*stored)
    if "updated_at" in stored and "updated_at" not in sets:
        sets["updated_at"] = now if now is not None else F.current_timestamp()
    df, hit = _marked(query)
    kinds = {f.name: f.dataType for f in query.df.schema.fields}
    return df.select(*[F.when(hit, sets[c].cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in stored])


def delete_all(query: Query) -> DataFrame:
    """The snapshot without the rows where the predicate is true; where it is null they stay."""
    _writable(query.entity)
    df, hit = _marked(query)
    return df.filter(~hit).select(*query.entity.stored_columns)


def affected(query: Query) -> int:
    """How many rows an update or a delete hits."""
    df, hit = _marked(query)
    return df.filter(hit).count()


def _on(a: DataFrame, b: DataFrame, keys) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def insert(entity: Entity, df: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot with the rows added; a key that is there already, or twice, is an error."""
    _writable(entity)
    rows = entity.with_defaults(rows)
    twice = rows.groupBy(*entity.key).count().filter("count > 1")
    if not rows.join(df, _on(rows, df, entity.key), "left_semi").isEmpty() or not twice.isEmpty():
        raise ConstraintViolation(f"{entity.table}: repeated key {entity.key}")
    return df.select(*entity.stored_columns).unionByName(rows)


def save(entity: Entity, df: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot with the rows replaced by key, or added. Of rows with the same key any one is taken."""
    _writable(entity)
    rows = entity.with_defaults(rows).dropDuplicates(list(entity.key))
    kept = df.join(rows, _on(df, rows, entity.key), "left_anti")
    return kept.select(*entity.stored_columns).unionByName(rows)


def update(entity: Entity, df: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot with the rows replaced by key; a key that isn't there is an error."""
    _writable(entity)
    if not rows.join(df, _on(rows, df, entity.key), "left_anti").isEmpty():
        raise EntityNotFound(f"{entity.table}: an updated row isn't there")
    return save(entity, df, rows)


def delete(entity: Entity, df: DataFrame, keys: DataFrame) -> DataFrame:
    """The snapshot without the rows of those keys; missing ones don't matter."""
    _writable(entity)
    return df.join(keys, _on(df, keys, entity.key), "left_anti").select(*entity.stored_columns)


def delete_id(entity: Entity, df: DataFrame, key: object) -> DataFrame:
    _writable(entity)
    return df.filter(~key_equals(entity, key))


def touch_updated_at(old: DataFrame, new: DataFrame, entity: Entity, now: Column) -> DataFrame:
    """``new`` with ``now`` as updated_at of rows that changed while their timestamp didn't."""
    was = old.select(*[F.col(f"`{k}`").alias(f"_old_{k}") for k in entity.key], F.struct(*entity.stored_columns).alias("_old"))
    got = new.join(was, [new[k].eqNullSafe(was[f"_old_{k}"]) for k in entity.key], "left")
    changed = F.col("_old").isNotNull() & ~F.struct(*entity.stored_columns).eqNullSafe(F.col("_old")) & F.col("updated_at").eqNullSafe(F.col("_old.updated_at"))
    return got.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at"))).select(*entity.stored_columns)


def violations(entity: Entity, df: DataFrame, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(rule, detail, rows): broken not-null, key, uniqueness and foreign-key rules; none if all hold."""
    parts = []
    needed = [f.name for f in entity.fields if not f.nullable]
    if needed:
        nulls = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in needed])
        each = F.explode(F.array(*[F.struct(F.lit("not null").alias("rule"), F.lit(c).alias("detail"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("rows")) for c in needed]))
        parts.append(nulls.select(each.alias("x")).select("x.*").filter("rows > 0"))
    for rule, columns in (("key", entity.key), *(("unique", u) for u in entity.unique)):
        have = df.filter(" and ".join(f"`{c}` is not null" for c in columns))
        twice = have.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(twice.groupBy().agg(F.lit(rule).alias("rule"), F.lit(", ".join(columns)).alias("detail"), F.count("*").alias("rows")).filter("rows > 0"))
    for fk in entity.foreign_keys:
        if parents is None or fk.parent not in parents:
            continue
        parent = parents[fk.parent].select(*[F.col(f"`{p}`").alias(f"_p{i}") for i, p in enumerate(fk.parent_columns)])
        own = df.filter(" and ".join(f"`{c}` is not null" for c in fk.columns))
        lost = own.join(parent, [own[c] == parent[f"_p{i}"] for i, c in enumerate(fk.columns)], "left_anti")
        parts.append(lost.groupBy().agg(F.lit("foreign key").alias("rule"), F.lit(fk.parent).alias("detail"), F.count("*").alias("rows")).filter("rows > 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require(entity: Entity, df: DataFrame, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``df`` if no rule is broken, else an error that names the broken ones."""
    found = violations(entity, df, parents).limit(20).collect()
    if found:
        raise ConstraintViolation(f"{entity.table}: " + "; ".join(f"{r.rule} ({r.detail}): {r.rows}" for r in found))
    return df
