"""Snapshots of a table as numbered Parquet folders, and the schema history of a set of tables.

A snapshot is written whole into a new folder; a one-row table that is written last says that it
counts. Readers take the highest number that counts, so a write that fails leaves nothing behind
that is read. One writer at a time is assumed. All paths go through Spark's writers and readers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import MigrationError


class Versions:
    """The snapshots under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> int:
        """The number of the current snapshot; 0 if there is none."""
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/published").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def publish(self, df: DataFrame, partition_by: Iterable[str] = ()) -> int:
        """Write ``df`` as the next snapshot and return its number."""
        number = self.current() + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/v{number:08d}")
        self.spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return number

    def read(self, version: int | None = None) -> DataFrame:
        number = self.current() if version is None else version
        if number < 1:
            raise MigrationError(f"{self.path} has no snapshot")
        return self.spark.read.parquet(f"{self.path}/v{number:08d}")

    def backup(self, to: str) -> None:
        """A copy of the current snapshot at a path where there is nothing yet."""
        self.read().write.mode("errorifexists").parquet(to)


def canonical_json(tables: Mapping[str, T.StructType]) -> str:
    """Schemas as JSON with sorted keys; the order of columns stays."""
    return json.dumps({k: json.loads(v.json()) for k, v in tables.items()}, sort_keys=True, indent=2, ensure_ascii=False)


def same_schema(a: Mapping[str, T.StructType], b: Mapping[str, T.StructType]) -> bool:
    return canonical_json(a) == canonical_json(b)


def drift(expected: Mapping[str, T.StructType], tables: Mapping[str, DataFrame], nullability: bool = False) -> list[str]:
    """How the tables differ from the schemas; empty if they don't. Metadata doesn't count.

    With ``nullability``, so does a column that may be null where none is expected. Tables read from
    Parquet say that of every column; ``mutations.violations`` looks at their values.
    """
    out = [f"{t} is missing" for t in sorted(set(expected) - set(tables))] + [f"{t} isn't expected" for t in sorted(set(tables) - set(expected))]
    for t in sorted(set(expected) & set(tables)):
        want = [(f.name, f.dataType.simpleString()) for f in expected[t].fields]
        have = [(f.name, f.dataType.simpleString()) for f in tables[t].schema.fields]
        if want != have:
            out.append(f"{t}: expected {want}, found {have}")
        elif nullability:
            out += [f"{t}.{f.name} may be null" for f, own in zip(expected[t].fields, tables[t].schema.fields, strict=True) if own.nullable and not f.nullable]
    return out


@dataclass(frozen=True)
class Delta:
    """Tables set whole, and tables dropped, between two schemas."""

    tables: Mapping[str, T.StructType]
    dropped: tuple[str, ...] = ()

    @staticmethod
    def between(old: Mapping[str, T.StructType], new: Mapping[str, T.StructType]) -> Delta:
        changed = {k: v for k, v in new.items() if k not in old or old[k].json() != v.json()}
        return Delta(changed, tuple(sorted(set(old) - set(new))))

    def apply(self, old: Mapping[str, T.StructType]) -> dict[str, T.StructType]:
        if both := set(self.tables) & set(self.dropped):
            raise MigrationError(f"set and dropped: {sorted(both)}")
        if unknown := set(self.dropped) - set(old):
            raise MigrationError(f"dropped but unknown: {sorted(unknown)}")
        return {**{k: v for k, v in old.items() if k not in self.dropped}, **self.tables}


@dataclass(frozen=True)
class Migration:
    """A named step from one set of tables to the next; ``schema`` is what it must give."""

    name: str
    schema: Mapping[str, T.StructType]
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    check: Callable[[dict[str, DataFrame]], list[str]] | None = None


def in_order(names: Iterable[str]) -> list[str]:
    """Migration names by the number that each begins with, of any length; an error without one, or with the same one twice."""
    numbered = {}
    for name in names:
        m = re.match(r"[0-9]+", name)
        if not m:
            raise MigrationError(f"{name!r} doesn't begin with a number")
        if (n := int(m[0])) in numbered:
            raise MigrationError(f"{name!r} and {numbered[n]!r} have the same number")
        numbered[n] = name
    return [numbered[n] for n in sorted(numbered)]


def pending(migrations: list[Migration], applied: list[str]) -> list[Migration]:
    """What is still to run; an error if the history isn't a prefix of the catalogue."""
    names = [m.name for m in migrations]
    if len(set(names)) < len(names):
        raise MigrationError("repeated migration names")
    if applied != names[: len(applied)]:
        raise MigrationError(f"the history {applied} isn't the beginning of {names}")
    return migrations[len(applied) :]


def migrate(tables: dict[str, DataFrame], migrations: list[Migration], applied: list[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables and the history after the pending steps. Nothing is stored: any failure leaves all as it was."""
    history = list(applied)
    for m in pending(migrations, applied):
        tables = m.run(dict(tables))
        if wrong := drift(m.schema, tables):
            raise MigrationError(f"{m.name}: {wrong}")
        if m.check and (broken := m.check(tables)):
            raise MigrationError(f"{m.name}: {broken}")
        history.append(m.name)
    return tables, history


def adopt(tables: dict[str, DataFrame], baseline: Migration, applied: list[str]) -> list[str]:
    """A history that begins with the baseline, for tables that have its schema and no history."""
    if applied:
        raise MigrationError("there is a history already")
    if wrong := drift(baseline.schema, tables):
        raise MigrationError(f"{baseline.name}: {wrong}")
    return [baseline.name]


def migration_stub(name: str, old: Mapping[str, T.StructType], new: Mapping[str, T.StructType]) -> str:
    """Python for a step: nullable columns that are added at the end are written, the rest is left to do."""
    delta, lines = Delta.between(old, new), []
    for t, schema in sorted(delta.tables.items()):
        before = old.get(t)
        added = schema.fields[len(before.fields) :] if before is not None else []
        if before is None:
            lines.append(f"    tables[{t!r}] = spark.createDataFrame([], {schema.simpleString()!r})")
        elif [f.json() for f in schema.fields[: len(before.fields)]] == [f.json() for f in before.fields] and all(f.nullable for f in added):
            lines += [f"    tables[{t!r}] = tables[{t!r}].withColumn({f.name!r}, F.lit(None).cast({f.dataType.simpleString()!r}))" for f in added]
        else:
            lines.append(f"    raise NotImplementedError({f'change {t} by hand'!r})")
    lines += [f"    raise NotImplementedError({f'drop {t} by hand'!r})" for t in delta.dropped]
    return "\n".join([f"def {name}(spark, tables):", *(lines or ["    pass"]), "    return tables", ""])
