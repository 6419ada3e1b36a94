"""SQLite files as a Spark data source: ``spark.read.format("tabulon_sqlite")``.

Options: path (a file that every executor sees), and table or query. With ``partitions`` and an
integer ``key`` column the rows are read in ranges of the key, in parallel; rows whose key is null
come with the first range. The file is opened read-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tabulon.shipping import ship

FETCH = 10_000


def _connect(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _relation(options: dict) -> str:
    if "query" in options:
        return f"({options['query']})"
    return '"' + options["table"].replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A table or a query of a SQLite file."""

    @classmethod
    def name(cls) -> str:
        return "tabulon_sqlite"

    def schema(self) -> str:
        """Declared types of a table's columns; a query's are strings unless a schema is given."""
        with _connect(self.options["path"]) as con:
            if "table" in self.options:
                info = con.execute(f"PRAGMA table_info({_relation(self.options)})").fetchall()
                return ", ".join(f"`{r[1]}` {_type(r[2])}" for r in info)
            names = [d[0] for d in con.execute(f"SELECT * FROM {_relation(self.options)} LIMIT 0").description]
            return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def _type(declared: str) -> str:
    kind = declared.upper()
    for part, spark_type in (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")):
        if part in kind:
            return spark_type
    return "string"


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = dict(options), schema

    def partitions(self) -> list[InputPartition]:
        n, key = int(self.options.get("partitions", 1)), self.options.get("key")
        if n <= 1 or not key:
            return [_Range(None, None)]
        with _connect(self.options["path"]) as con:
            low, high = con.execute(f'SELECT min("{key}"), max("{key}") FROM {_relation(self.options)}').fetchone()
        if low is None:
            return [_Range(None, None)]
        edges = [low + (high + 1 - low) * i // n for i in range(1, n)]
        return [_Range(a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        key, tests, values = self.options.get("key"), [], []
        if partition.low is not None:
            tests, values = [f'"{key}" >= ?'], [partition.low]
        if partition.high is not None:
            upper = f'"{key}" < ?'
            tests.append(upper if partition.low is not None else f'({upper} OR "{key}" IS NULL)')
            values.append(partition.high)
        names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.schema.fields)
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        con = _connect(self.options["path"])
        try:
            cursor = con.execute(f"SELECT {names} FROM {_relation(self.options)}{where}", values)
            while rows := cursor.fetchmany(FETCH):
                yield from rows
        finally:
            con.close()


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SqliteSource)
