"""JSON columns: text of nested arrays for indexes, and encodings of result values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import InvalidSchema


def check_array_path(path: str) -> list[str]:
    """The keys of a path ``$.a.b`` through arrays; it has no brackets, quotes, backslashes or empty keys."""
    head, *keys = path.split(".")
    if head != "$" or any(not k or any(ch in k for ch in '[]"\\\0') for k in keys):
        raise InvalidSchema(f"{path!r} is no path of keys")
    return keys


def _at(spread, path: str):
    return lambda v: spread(v, path)


def array_text(c: Column, path: str) -> Column:
    """The strings that a path reaches through any arrays on its way, joined by line feeds.

    Arrays within arrays count to a depth of two. Values of other kinds are left out; null and
    malformed JSON give ''.
    """
    cur = F.array(F.try_parse_json(c))

    def spread(v: Column, at: str) -> Column:
        return F.coalesce(F.try_variant_get(v, at, "array<variant>"), F.array(F.try_variant_get(v, at, "variant")))

    for _ in range(2):
        cur = F.flatten(F.transform(cur, _at(spread, "$")))
    for key in check_array_path(path):
        at = f"$.{key}" if key.isidentifier() else f"$['{key}']"
        cur = F.flatten(F.transform(cur, _at(spread, at)))
        # An array in an array is flattened too.
        cur = F.flatten(F.transform(cur, _at(spread, "$")))
    strings = F.transform(F.filter(cur, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.array_join(strings, "\n"), F.lit(""))


def plain_base64(c: Column) -> Column:
    """Base64 in one line; Spark's own breaks lines."""
    return F.translate(F.base64(c), "\r\n", "")


def json_value(c: Column, kind: T.DataType) -> Column:
    """A value as JSON text: null, numbers and text as such, binary as {_type, base64, size}."""
    if isinstance(kind, T.BinaryType):
        made = F.to_json(F.struct(F.lit("blob").alias("_type"), plain_base64(c).alias("base64"), F.octet_length(c).cast("string").alias("size")))
    elif isinstance(kind, T.BooleanType):
        made = c.cast("int").cast("string")
    elif isinstance(kind, (T.NumericType,)):
        made = c.cast("string")
    else:
        text = c.cast("string")
        made = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.coalesce(made, F.lit("null"))


def csv_value(c: Column) -> Column:
    """A CSV field: quoted if it has a comma, a quote or a line break; null is empty."""
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text), F.lit(""))
