"""Predicates as boolean columns, with three-valued logic.

``Columns(entity)`` gives a column by attribute or key; comparisons with None ask for null.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.schema import Entity

#: LIKE folds these letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No pattern contains it, so LIKE has no escape.
NO_ESCAPE = "\u0001"
#: Key lists longer than this become a join.
IN_LIMIT = 1000


def ascii_fold(c: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(c, UPPER, LOWER)


def like(c: Column, pattern: str) -> Column:
    """``%`` and ``_``, with ASCII letters alike in either case; a backslash is itself."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER))
    return F.like(ascii_fold(c), F.lit(folded), F.lit(NO_ESCAPE))


class Ref:
    """A named column of an entity, whose operators build predicates."""

    def __init__(self, name: str):
        self.name, self.column = name, F.col(f"`{name}`")

    def __eq__(self, other: object) -> Column:  # type: ignore[override]
        return self.column.isNull() if other is None else self.column == _value(other)

    def __ne__(self, other: object) -> Column:  # type: ignore[override]
        return self.column.isNotNull() if other is None else self.column != _value(other)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other: object) -> Column:
        return self.column < _value(other)

    def __le__(self, other: object) -> Column:
        return self.column <= _value(other)

    def __gt__(self, other: object) -> Column:
        return self.column > _value(other)

    def __ge__(self, other: object) -> Column:
        return self.column >= _value(other)

    def is_in(self, values: Iterable[object]) -> Column:
        """One of the values; of none is false, also for null."""
        values = list(values)
        return self.column.isin(values) if values else F.lit(False)

    def not_in(self, values: Iterable[object]) -> Column:
        """None of the values; of none is true, also for null."""
        values = list(values)
        return ~self.column.isin(values) if values else F.lit(True)

    def between(self, low: object, high: object) -> Column:
        return self.column.between(_value(low), _value(high))

    def is_null(self) -> Column:
        return self.column.isNull()

    def is_not_null(self) -> Column:
        return self.column.isNotNull()

    def like(self, pattern: str) -> Column:
        return like(self.column, pattern)

    def contains(self, s: str) -> Column:
        """As ``like`` with the string anywhere; its own wildcards count."""
        return like(self.column, f"%{s}%")

    def has_prefix(self, s: str) -> Column:
        return like(self.column, f"{s}%")

    def has_suffix(self, s: str) -> Column:
        return like(self.column, f"%{s}")


def _value(x: object) -> object:
    return x.column if isinstance(x, Ref) else x


class Columns:
    """The columns of an entity by property. A property without a column is an error at once."""

    def __init__(self, entity: Entity):
        self._entity = entity

    def __getattr__(self, prop: str) -> Ref:
        if prop.startswith("__"):
            raise AttributeError(prop)
        return Ref(self._entity.column(prop))

    __getitem__ = __getattr__


def raw(sql: str, values: Sequence[object] = ()) -> Column:
    """A predicate in Spark SQL; each ``?`` outside quotes takes the next value as a literal."""
    parts, quote, out, left = [], "", [], list(values)
    for ch in sql:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch == "?":
            parts.append("".join(out))
            out = []
            continue
        out.append(ch)
    parts.append("".join(out))
    if len(parts) - 1 != len(left):
        raise ValueError(f"{len(parts) - 1} places for {len(left)} values")
    text = parts[0]
    for v, rest in zip(left, parts[1:], strict=True):
        text += sql_literal(v) + rest
    return F.expr(text)


def sql_literal(v: object) -> str:
    """A Python value as a Spark SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, int):
        return f"{v}" if abs(v) < 1 << 31 else f"CAST('{v}' AS BIGINT)"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    kind = {"datetime": "TIMESTAMP", "date": "DATE"}.get(type(v).__name__)
    return f"{kind}'{text}'" if kind else f"'{text}'"


def key_equals(entity: Entity, key: object) -> Column:
    """The row of that key; a null part equals null."""
    parts = key if isinstance(key, (tuple, list)) else (key,)
    if len(parts) != len(entity.key):
        raise ValueError(f"{entity.table} has the key {entity.key}")
    out = None
    for name, part in zip(entity.key, parts, strict=True):
        one = F.col(f"`{name}`").eqNullSafe(F.lit(part))
        out = one if out is None else out & one
    return out


def key_in(df: DataFrame, entity: Entity, keys: Iterable[object]) -> DataFrame:
    """The rows with those keys: a list of literals if it is short, else a semi-join with the keys."""
    keys = [k if isinstance(k, (tuple, list)) else (k,) for k in keys]
    if not keys:
        return df.filter(F.lit(False))
    if len(entity.key) == 1 and len(keys) <= IN_LIMIT:
        c, values = F.col(f"`{entity.key[0]}`"), [k[0] for k in keys if k[0] is not None]
        found = c.isin(values) if values else F.lit(False)
        return df.filter(found | c.isNull() if len(values) < len(keys) else found)
    if len(keys) <= 20:
        found = None
        for k in keys:
            one = key_equals(entity, tuple(k))
            found = one if found is None else found | one
        return df.filter(found)
    schema = ", ".join(f"_k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(entity.key))
    wanted = df.sparkSession.createDataFrame([tuple(k) for k in keys], schema)
    return df.join(wanted, [df[c].eqNullSafe(wanted[f"_k{i}"]) for i, c in enumerate(entity.key)], "left_semi")
