"""Parameterised SQL, and queries answered page by page."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import QueryFailed, ReadOnlyViolation
from tabulon.functions.json_text import csv_value, json_value
from tabulon.operators.predicates import Ref
from tabulon.schema import Entity

READS = ("SELECT", "WITH", "DESCRIBE", "SHOW")
DEFAULT_PAGE, LARGEST_PAGE = 50, 1000


class Sql:
    """SQL text with values bound by place: ``Sql("SELECT * FROM ").table(e).text(" WHERE a > ").value(3)``."""

    def __init__(self, text: str = ""):
        self.parts, self.args = [text], []

    def text(self, raw: str) -> Sql:
        self.parts.append(raw)
        return self

    def table(self, entity: Entity | str) -> Sql:
        return self.text(f"`{entity if isinstance(entity, str) else entity.table}`")

    def column(self, c: Ref | str, entity: Entity | None = None) -> Sql:
        name = c.name if isinstance(c, Ref) else entity.column(c) if entity else c
        return self.text(f"`{name}`")

    def value(self, v: object) -> Sql:
        self.args.append(v)
        return self.text("?")

    def run(self, spark: SparkSession) -> DataFrame:
        df = spark.sql("".join(self.parts), args=self.args)
        if len(set(df.columns)) < len(df.columns):
            raise QueryFailed(f"repeated result names in {df.columns}")
        return df

    def all(self, spark: SparkSession) -> list[Row]:
        return self.run(spark).collect()

    def one(self, spark: SparkSession) -> Row | None:
        return self.run(spark).first()

    def scalar(self, spark: SparkSession) -> object:
        row = self.one(spark)
        return None if row is None else row[0]


def parameter(v: object) -> object:
    """A JSON value as a parameter: booleans are 0 and 1, lists and objects their JSON text."""
    if isinstance(v, bool):
        return int(v)
    return json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v


def check_query(sql: str) -> str:
    """The text without a final semicolon, if it reads."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise QueryFailed("an empty query")
    if not text.upper().startswith(READS):
        raise QueryFailed("only queries that read are answered here")
    return text


def check_execute(sql: str, readonly: bool) -> str:
    """The text, if it writes and may."""
    if readonly:
        raise ReadOnlyViolation("the session is read-only")
    text = sql.strip()
    if not text or re.match(r"(?i)(SELECT|WITH)\b", text):
        raise QueryFailed("only statements that write are executed here")
    return text


@dataclass(frozen=True)
class Page:
    columns: list[str]
    rows: list[Row]
    page: int
    page_size: int
    total: int

    @property
    def total_pages(self) -> int:
        return max(1, math.ceil(self.total / self.page_size))


def page_of(df: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    """The rows of one page; pages begin at 1 and have 1 to 1000 rows, 50 by default."""
    n = min(LARGEST_PAGE, max(1, DEFAULT_PAGE if size is None else size))
    return df.offset((max(1, page) - 1) * n).limit(n)


def query_page(spark: SparkSession, sql: str, params: list[object] | None = None, page: int = 1, size: int | None = None) -> Page:
    """One page of a query, and how many rows it has in all."""
    df = spark.sql(check_query(sql), args=[parameter(p) for p in params or []])
    n = min(LARGEST_PAGE, max(1, DEFAULT_PAGE if size is None else size))
    return Page(df.columns, page_of(df, page, size).collect(), max(1, page), n, df.count())


def as_json(df: DataFrame) -> Column:
    """A row of ``df`` as a JSON object, with binary values as {_type, base64, size}."""
    parts = []
    for k, f in enumerate(df.schema.fields):
        parts += [F.lit(("" if not k else ",") + json.dumps(f.name, ensure_ascii=False) + ":"), json_value(F.col(f"`{f.name}`"), f.dataType)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def as_csv(df: DataFrame) -> Column:
    """A row of ``df`` as a line of CSV."""
    return F.concat_ws(",", *[csv_value(F.col(f"`{c}`")) for c in df.columns])


def write_csv(df: DataFrame, to: str) -> None:
    """CSV files with a header; null is empty."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(to)


def schema_of(spark: SparkSession) -> DataFrame:
    """(table, column, position, type, nullable) of the session's tables and views, in order."""
    rows = [
        (t.name, f.name, k, f.dataType.simpleString(), f.nullable)
        for t in sorted(spark.catalog.listTables(), key=lambda t: t.name)
        for k, f in enumerate(spark.table(f"`{t.name}`").schema.fields)
    ]
    return spark.createDataFrame(rows, "table string, column string, position int, type string, nullable boolean")
