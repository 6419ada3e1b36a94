"""Entities: declared columns, keys, nested columns and full-text indexes of a table.

A declaration becomes a ``StructType`` and a projection of a DataFrame. Names are resolved when a
query is built, so a property that isn't mapped is an error before there is any plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import InvalidSchema, QueryFailed

TOKENIZERS = ("unicode", "porter", "trigram")
RESERVED_INDEX_COLUMNS = ("rank", "rowid")


def snake_case(name: str) -> str:
    """``createdAt`` as ``created_at``: an underscore before every capital, also in a row of them."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


@dataclass(frozen=True)
class Field:
    """A stored column. ``default`` is a literal; ``default_sql`` a Spark SQL expression."""

    name: str
    type: T.DataType
    nullable: bool = False
    unique: bool = False
    default: object = None
    default_sql: str | None = None

    def struct_field(self) -> T.StructField:
        meta = {k: v for k, v in (("unique", self.unique), ("default", self.default), ("default_sql", self.default_sql)) if v not in (None, False)}
        return T.StructField(self.name, self.type, self.nullable, meta)

    def default_column(self) -> Column | None:
        if self.default_sql is not None:
            return F.expr(self.default_sql).cast(self.type)
        return None if self.default is None else F.lit(self.default).cast(self.type)


@dataclass(frozen=True)
class Nested:
    """A property inside a JSON text or struct column, as a column ``a__b``.

    By default the value has the declared type of the leaf; with ``text_affinity`` it is text,
    and so compares as text.
    """

    path: str
    type: T.DataType = T.StringType()
    text_affinity: bool = False

    @property
    def column(self) -> str:
        return self.path.replace(".", "__")

    def value(self, types: dict[str, T.DataType]) -> Column:
        root, _, rest = self.path.partition(".")
        if isinstance(types[root], T.StringType):
            out = F.get_json_object(f"`{root}`", f"$.{rest}")
        else:
            out = F.col(f"`{root}`.{rest}")
        return out.cast(T.StringType() if self.text_affinity else self.type)


@dataclass(frozen=True)
class FullTextIndex:
    """A named set of text columns (stored or nested) and the tokenizer that they are read with."""

    columns: tuple[str, ...]
    name: str | None = None
    tokenizer: str = "unicode"


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


class Entity:
    """A table with its declared columns.

    A writable entity needs a key and non-null ``created_at`` and ``updated_at`` timestamps; a
    read-only one needs neither timestamp.
    """

    def __init__(
        self,
        table: str,
        fields: Iterable[Field],
        key: Iterable[str],
        nested: Iterable[Nested] = (),
        indexes: Iterable[FullTextIndex] = (),
        foreign_keys: Iterable[ForeignKey] = (),
        unique: Iterable[tuple[str, ...]] = (),
        readonly: bool = False,
        local_only: bool = False,
        timestamps: bool = True,
    ):
        self.table, self.fields, self.key = table, tuple(fields), tuple(key)
        self.nested, self.indexes, self.foreign_keys = tuple(nested), tuple(indexes), tuple(foreign_keys)
        self.unique = (*tuple(unique), *((f.name,) for f in self.fields if f.unique))
        self.readonly, self.local_only = readonly, local_only
        self._check(timestamps and not readonly)

    def _check(self, timestamps: bool) -> None:
        names = [f.name for f in self.fields] + [n.column for n in self.nested]
        if repeated := {n for n in names if [x.lower() for x in names].count(n.lower()) > 1}:
            raise InvalidSchema(f"{self.table}: repeated columns {sorted(repeated)}")
        by_name = {f.name: f for f in self.fields}
        if not self.key:
            raise InvalidSchema(f"{self.table}: no key")
        for k in self.key:
            if k not in by_name:
                raise InvalidSchema(f"{self.table}: the key column {k} isn't declared")
            if by_name[k].nullable:
                raise InvalidSchema(f"{self.table}: the key column {k} is nullable")
        if timestamps:
            for k in ("created_at", "updated_at"):
                if k not in by_name or by_name[k].nullable or not isinstance(by_name[k].type, T.TimestampType):
                    raise InvalidSchema(f"{self.table}: {k} must be a timestamp that isn't null")
        for n in self.nested:
            if n.path.partition(".")[0] not in by_name:
                raise InvalidSchema(f"{self.table}: {n.path} is in no declared column")
        seen = set()
        for i in self.indexes:
            if i.tokenizer not in TOKENIZERS:
                raise InvalidSchema(f"{self.table}: no tokenizer {i.tokenizer}")
            if not i.columns or (name := self.index_name(i)) in seen:
                raise InvalidSchema(f"{self.table}: an index without columns, or a repeated index")
            seen.add(name)
            for c in i.columns:
                if c in RESERVED_INDEX_COLUMNS:
                    raise InvalidSchema(f"{self.table}: {c} is a reserved name in an index")
                if not isinstance(self.type_of(c), T.StringType):
                    raise InvalidSchema(f"{self.table}: the indexed column {c} isn't text")

    def index_name(self, index: FullTextIndex) -> str:
        return index.name or f"{self.table}_fts"

    def index(self, name: str | None = None) -> FullTextIndex:
        """The index of that name; without a name the only one."""
        if name is None:
            if len(self.indexes) != 1:
                raise QueryFailed(f"{self.table}: name one of the indexes {[self.index_name(i) for i in self.indexes]}")
            return self.indexes[0]
        for i in self.indexes:
            if self.index_name(i) == name:
                return i
        raise QueryFailed(f"{self.table}: no index {name}, only {[self.index_name(i) for i in self.indexes]}")

    def column(self, prop: str) -> str:
        """The column of a property: its own name, its snake case, or a nested path."""
        names = {f.name for f in self.fields} | {n.column for n in self.nested}
        for name in (prop, snake_case(prop), prop.replace(".", "__")):
            if name in names:
                return name
        raise InvalidSchema(f"{self.table} has no column for {prop!r}")

    def type_of(self, prop: str) -> T.DataType:
        name = self.column(prop)
        for f in self.fields:
            if f.name == name:
                return f.type
        n = next(n for n in self.nested if n.column == name)
        return T.StringType() if n.text_affinity else n.type

    @property
    def stored_columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def struct_type(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def view(self, df: DataFrame) -> DataFrame:
        """The stored columns of ``df`` in declared order, and the nested ones."""
        missing = [c for c in self.stored_columns if c not in df.columns]
        if missing:
            raise InvalidSchema(f"{self.table}: the table lacks {missing}")
        types = {f.name: df.schema[f.name].dataType for f in self.fields}
        return df.select(*[F.col(f"`{c}`") for c in self.stored_columns], *[n.value(types).alias(n.column) for n in self.nested])

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return self.view(spark.read.parquet(path))

    def with_defaults(self, df: DataFrame) -> DataFrame:
        """``df`` with a column for each field: missing columns, and nulls of fields that can't be null, take defaults."""
        out = []
        for f in self.fields:
            d = f.default_column()
            if f.name in df.columns:
                value = F.col(f"`{f.name}`").cast(f.type)
                out.append((F.coalesce(value, d) if d is not None and not f.nullable else value).alias(f.name))
            elif d is not None:
                out.append(d.alias(f.name))
            elif f.nullable:
                out.append(F.lit(None).cast(f.type).alias(f.name))
            else:
                raise InvalidSchema(f"{self.table}: {f.name} has neither a value nor a default")
        return df.select(*out)

    def from_json(self, df: DataFrame, column: str) -> DataFrame:
        """Rows decoded from JSON text, field by field.

        A value of the wrong kind becomes the field's default; without one, null in a nullable
        field, and an error in any other. A missing or null value of a nullable field is null,
        even where the field has a default.
        """
        doc = F.try_parse_json(F.col(column))
        out = []
        for f in self.fields:
            simple = not isinstance(f.type, (T.ArrayType, T.MapType, T.StructType))
            raw = F.get_json_object(column, f"$.{f.name}")
            value = F.try_variant_get(doc, f"$.{f.name}", f.type.simpleString()) if simple or isinstance(f.type, T.ArrayType) else F.from_json(raw, f.type)
            d = f.default_column()
            if d is not None:
                value = F.when(raw.isNull(), F.lit(None).cast(f.type) if f.nullable else d).otherwise(F.coalesce(value, d))
            elif not f.nullable:
                value = F.coalesce(value, F.raise_error(F.lit(f"{self.table}.{f.name} can't be decoded")).cast(f.type))
            out.append(value.alias(f.name))
        return df.select(*out)
