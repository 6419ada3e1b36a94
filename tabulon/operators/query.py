"""Queries over one entity, as an immutable description that becomes one DataFrame.

Filters are joined by AND, each as a unit. Orderings add up, earlier ones first, and ranks come
before them, the newest first. Of several limits or offsets the last one holds; the offset is
taken before the limit. Aggregates use the filters alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import EntityNotFound, QueryFailed
from tabulon.operators import fulltext
from tabulon.operators.predicates import Columns, key_equals, key_in
from tabulon.schema import Entity


@dataclass(frozen=True)
class Query:
    """A query over ``df``, which has the columns of ``entity.view``."""

    entity: Entity
    df: DataFrame
    predicates: tuple[Column, ...] = ()
    key_lists: tuple[tuple, ...] = ()
    matches: tuple[tuple[fulltext.Match, str | None], ...] = ()
    ranks: tuple[tuple[fulltext.Match, str | None, tuple[float, ...]], ...] = ()
    orders: tuple[Column, ...] = ()
    columns: tuple[str, ...] = ()
    limit_to: int | None = None
    skip: int | None = None
    is_distinct: bool = field(default=False)

    # filters

    def filter(self, predicate: Column | Callable[[Columns], Column]) -> Query:
        if callable(predicate) and not isinstance(predicate, Column):
            predicate = predicate(Columns(self.entity))
        return replace(self, predicates=(*self.predicates, predicate))

    def where(self, prop: str, *, equals: object = None, is_in: Iterable[object] | None = None, between: tuple | None = None) -> Query:
        ref = Columns(self.entity)[prop]
        if is_in is not None:
            return self.filter(ref.is_in(is_in))
        return self.filter(ref.between(*between) if between is not None else ref == equals)

    def by_id(self, key: object) -> Query:
        return self.filter(key_equals(self.entity, key))

    def by_ids(self, keys: Iterable[object]) -> Query:
        return replace(self, key_lists=(*self.key_lists, tuple(keys)))

    def search(self, text: str, index: str | None = None) -> Query:
        """Rows of the index that hold the text as a phrase; blank text finds nothing."""
        return self.matching(fulltext.Phrase(text), index)

    def matching(self, match: fulltext.Match, index: str | None = None) -> Query:
        self.entity.index(index)
        return replace(self, matches=(*self.matches, (match, index)))

    # order and paging

    def order(self, by: str | Column, ascending: bool = True) -> Query:
        """A property, or any column or expression."""
        c = by if isinstance(by, Column) else F.col(f"`{self.entity.column(by)}`")
        return replace(self, orders=(*self.orders, c.asc_nulls_first() if ascending else c.desc_nulls_last()))

    def order_desc(self, by: str | Column) -> Query:
        return self.order(by, ascending=False)

    def order_sql(self, sql: str, ascending: bool = True) -> Query:
        return self.order(F.expr(sql), ascending)

    def order_by_rank(self, match: fulltext.Match, index: str | None = None, weights: Iterable[float] = ()) -> Query:
        """Best matches first. It comes before all orderings and earlier ranks."""
        self.entity.index(index)
        return replace(self, ranks=((match, index, tuple(weights)), *self.ranks))

    def limit(self, n: int) -> Query:
        return replace(self, limit_to=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    # projection

    def select(self, *props: str) -> Query:
        names = tuple(self.entity.column(p) for p in props)
        if len(set(names)) < len(names):
            raise QueryFailed(f"repeated columns in {names}: a row can hold one of a name")
        return replace(self, columns=names)

    def distinct(self) -> Query:
        return replace(self, is_distinct=True)

    # results

    def filtered(self) -> DataFrame:
        """The rows that pass the filters, with every column of the entity."""
        out = self.df
        for p in self.predicates:
            out = out.filter(p)
        for keys in self.key_lists:
            out = key_in(out, self.entity, keys)
        for match, index in self.matches:
            out = fulltext.matching(out, self.entity, match, index)
        return out

    def _projected(self, rows: DataFrame) -> DataFrame:
        out = rows.select(*[f"`{c}`" for c in self.columns or self.entity.stored_columns])
        return out.distinct() if self.is_distinct else out

    def dataframe(self) -> DataFrame:
        rows = self.filtered()
        by: list[Column] = []
        for k, (match, index, weights) in enumerate(self.ranks):
            rows = fulltext.with_rank(rows, self.df, self.entity, match, index, weights, f"_rank{k}")
            by.append(F.col(f"_rank{k}").asc_nulls_last())
        by += self.orders
        if self.is_distinct and by:
            # Only columns of the result order a distinct result, as in SQL.
            rows = self._projected(rows).orderBy(*by)
        elif by:
            rows = self._projected(rows.orderBy(*by))
        else:
            rows = self._projected(rows)
        if self.skip:
            rows = rows.offset(self.skip)
        return rows if self.limit_to is None else rows.limit(self.limit_to)

    def all(self) -> list[Row]:
        return self.dataframe().collect()

    def first(self) -> Row | None:
        return self.limit(1).dataframe().first()

    def get(self) -> Row:
        row = self.first()
        if row is None:
            raise EntityNotFound(self.entity.table)
        return row

    # aggregates

    def aggregate(self, *, count: bool = False, **wanted: tuple[str, str]) -> DataFrame:
        """One row of aggregates in a single pass: ``total=("sum", "price")``; also min, max and avg."""
        makers = {"min": F.min, "max": F.max, "avg": F.avg, "sum": self._sum}
        aggs = [F.count("*").alias("count")] if count else []
        for name, (what, prop) in wanted.items():
            aggs.append((makers[what](self.entity.column(prop)) if what != "sum" else self._sum(prop)).alias(name))
        return self.filtered().agg(*aggs)

    def _sum(self, prop: str) -> Column:
        """A sum that is 0 over no rows; it raises on overflow."""
        c = self.entity.column(prop)
        zero = F.lit(0.0) if isinstance(self.df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")
        return F.coalesce(F.sum(F.col(f"`{c}`")), zero)

    def count(self) -> int:
        """Rows that pass the filters; of a distinct query, its distinct rows."""
        return (self._projected(self.filtered()) if self.is_distinct else self.filtered()).count()

    def exists(self) -> bool:
        return not self.filtered().isEmpty()

    def is_empty(self) -> bool:
        return not self.exists()

    def _scalar(self, c: Column) -> object:
        return self.filtered().agg(c).first()[0]

    def min(self, prop: str) -> object:
        return self._scalar(F.min(f"`{self.entity.column(prop)}`"))

    def max(self, prop: str) -> object:
        return self._scalar(F.max(f"`{self.entity.column(prop)}`"))

    def sum(self, prop: str) -> object:
        return self._scalar(self._sum(prop))

    def avg(self, prop: str) -> float | None:
        return self._scalar(F.avg(f"`{self.entity.column(prop)}`"))


def query(entity: Entity, df: DataFrame) -> Query:
    """A query over all rows of ``df``."""
    return Query(entity, entity.view(df))
