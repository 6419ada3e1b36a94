"""Full-text search over the text columns of an index: matches, ranks and postings.

A match is built from ``Phrase``, ``Prefix``, ``First``, ``Near`` and ``In`` with ``&``, ``|`` and ``-``, or
read from text by ``match_text.parse``. It becomes a boolean column, over token strings or over
postings, so it filters like any other predicate. BM25 ranks are negative: lower is better.

``matching`` and ``with_rank`` read the texts. For tables that are searched often, ``postings`` and
``row_lengths`` make an inverted index as tables to be written, bucketed or partitioned by term;
``find`` searches and ranks by them and reads the postings of the wanted terms alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import InvalidSchema, QueryFailed
from tabulon.functions import text as X
from tabulon.functions.porter import stem
from tabulon.schema import Entity, FullTextIndex

#: Constants of BM25, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SHORTEST_SUBSTRING = 3
#: Letters at the end of a stem that its words needn't have.
STEM_ENDING = 2


class Match:
    """What a row's tokens are held against."""

    def __and__(self, other: Match) -> Match:
        return _Both(self, other)

    def __or__(self, other: Match) -> Match:
        return _Either(self, other)

    def __sub__(self, other: Match) -> Match:
        return _Without(self, other)

    def column(self, at: _Where) -> Column:
        raise NotImplementedError

    def phrases(self) -> list[tuple[Phrase, tuple[str, ...] | None]]:
        """The phrases that count for the rank, with the columns they are restricted to."""
        return []


class _Where:
    """The columns of an index, and what stands for their tokens."""

    tokenizer: str
    columns: dict[str, object]

    def tokens(self, text: str) -> list[str]:
        found = X.tokens_of_text(text)
        return [stem(t) for t in found] if self.tokenizer == "porter" else found

    def only(self, names: tuple[str, ...]) -> _Where:
        if unknown := set(names) - set(self.columns):
            raise QueryFailed(f"no column {sorted(unknown)} in the index")
        return type(self)({k: v for k, v in self.columns.items() if k in names}, self.tokenizer)

    def _any(self, test) -> Column:
        out = F.lit(False)
        for c in self.columns.values():
            out = out | test(c)
        return out

    def has(self, p: Phrase) -> Column:
        raise NotImplementedError

    def near(self, a: list[str], b: list[str], distance: int) -> Column:
        raise NotImplementedError

    def times(self, p: Phrase, weights: dict[str, float]) -> Column:
        raise NotImplementedError


@dataclass
class _Texts(_Where):
    """Token strings by column."""

    columns: dict[str, Column]
    tokenizer: str

    def has(self, p: Phrase) -> Column:
        if self.tokenizer == "trigram":
            s = p.text.strip().lower()
            if len(s) < SHORTEST_SUBSTRING:
                return F.lit(False)
            return self._any(lambda c: c.startswith(s) if p.first else c.contains(s))
        t = self.tokens(p.text)
        s = " " + " ".join(t) + ("" if p.prefix else " ")
        return self._any(lambda c: c.startswith(s) if p.first else c.contains(s)) if t else F.lit(False)

    def near(self, a: list[str], b: list[str], distance: int) -> Column:
        x, y, gap = " ".join(a), " ".join(b), f"(?: [^ ]+){{0,{distance}}} "
        return self._any(lambda c: c.rlike(f" {x}{gap}{y} | {y}{gap}{x} "))

    def times(self, p: Phrase, weights: dict[str, float]) -> Column:
        t = self.tokens(p.text)
        out = F.lit(0.0)
        for k, c in self.columns.items() if t else ():
            n = F.when(c.startswith(" " + " ".join(t) + ("" if p.prefix else " ")), 1).otherwise(0) if p.first else X.occurrences(c, t, p.prefix)
            out = out + n * weights[k]
        return out


@dataclass
class _Words(_Texts):
    """Token strings that aren't stemmed: what a row has at least if its stems match."""

    def has(self, p: Phrase) -> Column:
        t = self.tokens(p.text)
        return self._any(lambda c: c.contains(" " + t[0][: max(1, len(t[0]) - STEM_ENDING)])) if t else F.lit(False)

    def near(self, a: list[str], b: list[str], distance: int) -> Column:
        return F.lit(True)


@dataclass
class _Positions(_Where):
    """Positions by column, and there by a term or a prefix."""

    columns: dict[str, dict[tuple[str, bool], Column]]
    tokenizer: str

    def _of(self, c: dict[tuple[str, bool], Column], t: list[str], prefix: bool) -> Column:
        """Where consecutive tokens begin."""
        def before(k: int) -> Column:
            return F.transform(c[t[k], prefix and k == len(t) - 1], lambda p: p - k)

        out = before(0)
        for k in range(1, len(t)):
            out = F.array_intersect(out, before(k))
        return out

    def has(self, p: Phrase) -> Column:
        t = self.tokens(p.text)

        def test(c) -> Column:
            found = self._of(c, t, p.prefix)
            return F.array_contains(found, 0) if p.first else F.size(found) > 0

        return self._any(test) if t else F.lit(False)

    def near(self, a: list[str], b: list[str], distance: int) -> Column:
        def test(c) -> Column:
            x, y = self._of(c, a, False), self._of(c, b, False)
            return F.exists(x, lambda p: F.exists(y, lambda q: (q - p - len(a)).between(0, distance) | (p - q - len(b)).between(0, distance)))

        return self._any(test)

    def times(self, p: Phrase, weights: dict[str, float]) -> Column:
        t = self.tokens(p.text)
        out = F.lit(0.0)
        for k, c in self.columns.items() if t else ():
            found = self._of(c, t, p.prefix)
            out = out + (F.array_contains(found, 0).cast("int") if p.first else F.size(found)) * weights[k]
        return out


@dataclass
class _Wanted(_Where):
    """Takes down which terms and prefixes a match asks for."""

    columns: dict[str, object]
    tokenizer: str
    terms: set[tuple[str, bool]] = field(default_factory=set)

    def only(self, names: tuple[str, ...]) -> _Where:
        super().only(names)
        return self

    def has(self, p: Phrase) -> Column:
        t = self.tokens(p.text)
        self.terms |= {(x, p.prefix and k == len(t) - 1) for k, x in enumerate(t)}
        return F.lit(True)

    def near(self, a: list[str], b: list[str], distance: int) -> Column:
        self.terms |= {(x, False) for x in (*a, *b)}
        return F.lit(True)


@dataclass(frozen=True)
class Phrase(Match):
    """Consecutive tokens; without tokens it matches nothing. Under trigrams, a substring."""

    text: str
    prefix = False
    first = False

    def column(self, at: _Where) -> Column:
        return at.has(self)

    def phrases(self):
        return [(self, None)]


Term = Phrase


@dataclass(frozen=True)
class Prefix(Phrase):
    """Consecutive tokens of which the last one only begins so."""

    prefix = True


@dataclass(frozen=True)
class First(Phrase):
    """Consecutive tokens that a column begins with."""

    first = True


@dataclass(frozen=True)
class FirstPrefix(Prefix):
    """The same where the last token only begins so."""

    first = True


@dataclass(frozen=True)
class Near(Match):
    """Two phrases in one column with at most ``distance`` tokens between them, in either order."""

    a: str
    b: str
    distance: int = 10

    def column(self, at: _Where) -> Column:
        a, b = at.tokens(self.a), at.tokens(self.b)
        return at.near(a, b, self.distance) if a and b else F.lit(False)

    def phrases(self):
        return [(Phrase(self.a), None), (Phrase(self.b), None)]


@dataclass(frozen=True)
class In(Match):
    """A match within some of the index's columns."""

    match: Match
    columns: tuple[str, ...]

    def column(self, at: _Where) -> Column:
        return self.match.column(at.only(self.columns))

    def phrases(self):
        return [(p, self.columns if own is None else tuple(c for c in own if c in self.columns)) for p, own in self.match.phrases()]


@dataclass(frozen=True)
class _Both(Match):
    a: Match
    b: Match

    def column(self, at: _Where) -> Column:
        return self.a.column(at) & self.b.column(at)

    def phrases(self):
        return self.a.phrases() + self.b.phrases()


@dataclass(frozen=True)
class _Either(_Both):
    def column(self, at: _Where) -> Column:
        return self.a.column(at) | self.b.column(at)


@dataclass(frozen=True)
class _Without(_Both):
    def column(self, at: _Where) -> Column:
        if isinstance(at, _Words):  # a row that has words of both may have the stem of one only
            return self.a.column(at)
        # Both sides are asked for what they want.
        return self.a.column(at) & ~self.b.column(at)

    def phrases(self):
        return self.a.phrases()


def _strings(entity: Entity, i: FullTextIndex, tokenizer: str) -> dict[str, Column]:
    """The token string of each of the index's columns."""
    made = {}
    for c in i.columns:
        source = F.col(f"`{entity.column(c)}`")
        made[c] = F.lower(F.coalesce(source, F.lit(""))) if tokenizer == "trigram" else X.padded_tokens(source, tokenizer)
    return made


def _held(made: dict[str, Column], test) -> Column:
    """A test of token strings that computes each of them once a row: they go into an array of one struct."""
    names = {c: f"t{k}" for k, c in enumerate(made)}
    row = F.array(F.struct(*[v.alias(names[c]) for c, v in made.items()]))
    return F.exists(row, lambda s: test({c: s[n] for c, n in names.items()}))


def matching(df: DataFrame, entity: Entity, match: Match, index: str | None = None) -> DataFrame:
    """The rows that match; null texts have no tokens.

    Stems are made in Python, so under the Porter tokenizer rows without a word that begins like a
    wanted stem are left out before.
    """
    i = entity.index(index)
    if i.tokenizer == "porter":
        df = df.filter(_held(_strings(entity, i, "unicode"), lambda c: match.column(_Words(c, "porter"))))
    return df.filter(_held(_strings(entity, i, i.tokenizer), lambda c: match.column(_Texts(c, i.tokenizer))))


def _counted(match: Match, i: FullTextIndex, weights: tuple[float, ...]) -> tuple[list[tuple[Phrase, tuple[str, ...]]], dict[str, float]]:
    if i.tokenizer == "trigram":
        raise QueryFailed("a substring index has no rank")
    every = [(p, i.columns if only is None else only) for p, only in match.phrases()]
    return [(p, only) for p, only in every if only and X.tokens_of_text(p.text)], dict(zip(i.columns, (*weights, *[1.0] * len(i.columns)), strict=False))


def _bm25(n_rows: int, mean: float, counts: list[int], times: list[Column], length: Column) -> Column:
    rank = F.lit(0.0)
    for n, f in zip(counts, times, strict=True):
        idf = max(math.log((n_rows - n + 0.5) / (n + 0.5)), LEAST_IDF) if n_rows else LEAST_IDF
        rank = rank - F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
    return rank


def with_rank(rows: DataFrame, corpus: DataFrame, entity: Entity, match: Match, index: str | None = None, weights: tuple[float, ...] = (), name: str = "rank") -> DataFrame:
    """``rows`` with their BM25 rank against ``corpus``; null where the row doesn't match.

    One pass over the corpus gives the number of rows, their mean length and, for each phrase or
    prefix, in how many rows it occurs. ``weights`` are those of the index's columns, 1 where none
    is given.
    """
    i = entity.index(index)
    found, weight = _counted(match, i, weights)
    names = {c: f"_tok{k}" for k, c in enumerate(i.columns)}
    made = {names[c]: v for c, v in _strings(entity, i, i.tokenizer).items()}
    at = _Texts({c: F.col(n) for c, n in names.items()}, i.tokenizer)
    length = sum((X.token_count(c) for c in at.columns.values()), F.lit(0))

    tokens = corpus.select(*[v.alias(n) for n, v in made.items()])
    stats = tokens.agg(F.count("*"), F.avg(length), *[F.count_if(p.column(at.only(only))) for p, only in found]).first()
    own = {f"_f{k}": at.only(only).times(p, weight) for k, (p, only) in enumerate(found)}
    out = rows.withColumns(made).withColumns(own | {"_len": length, "_hit": match.column(at)})
    rank = _bm25(stats[0], stats[1] or 1.0, list(stats[2:]), [F.col(f) for f in own], F.col("_len"))
    return out.select(*[f"`{c}`" for c in rows.columns], F.when(F.col("_hit"), rank).alias(name))


def postings(df: DataFrame, entity: Entity, index: str | None = None) -> DataFrame:
    """(term, key columns, column, tf, positions): a row per term of a row's column."""
    i = entity.index(index)
    if i.tokenizer == "trigram":
        raise QueryFailed("a substring index has no terms")
    out = None
    for c in i.columns:
        tokens = X.tokens(F.col(f"`{entity.column(c)}`"), i.tokenizer)
        one = df.select(*entity.key, F.lit(c).alias("column"), F.posexplode(tokens).alias("pos", "term"))
        out = one if out is None else out.unionByName(one)
    grouped = out.groupBy("term", *entity.key, "column").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", *entity.key, "column", "tf", "positions")


def row_lengths(df: DataFrame, entity: Entity, index: str | None = None) -> DataFrame:
    """(key columns, tokens): how many tokens each row has in all columns of the index."""
    i = entity.index(index)
    strings = _strings(entity, i, "unicode").values()  # stems are as many as words
    return df.select(*entity.key, sum((X.token_count(s) for s in strings), F.lit(0)).cast("long").alias("tokens"))


def find(stored: DataFrame, lengths: DataFrame, entity: Entity, match: Match, index: str | None = None, weights: tuple[float, ...] = ()) -> DataFrame:
    """(key columns, rank) of the rows that match, from ``postings`` and ``row_lengths``.

    Reads the postings of the terms and prefixes that the match names, and gathers their positions
    by row, so it costs what these terms occur. The rows that hold a term are counted there, and the
    mean length in ``lengths``. A match that holds without any of its terms isn't possible: what is
    only excluded has nothing to be excluded from.
    """
    i = entity.index(index)
    found, weight = _counted(match, i, weights)
    asked = _Wanted(dict.fromkeys(i.columns), i.tokenizer)
    match.column(asked)
    terms = sorted(asked.terms)
    tests = [F.col("term").startswith(t) if prefix else F.col("term") == t for t, prefix in terms]
    wanted = F.lit(False)
    for t in tests:
        wanted = wanted | t
    none = F.array().cast("array<int>")
    names, aggs = {c: {} for c in i.columns}, []
    for c in i.columns:
        for k, (t, test) in enumerate(zip(terms, tests, strict=True)):
            name = f"_p{len(aggs)}"
            names[c][t] = F.col(name)
            aggs.append(F.flatten(F.collect_list(F.when((F.col("column") == c) & test, F.col("positions")).otherwise(none))).alias(name))
    if not aggs:
        return stored.select(*entity.key, F.lit(0.0).alias("rank")).limit(0)
    rows = stored.filter(wanted).groupBy(*entity.key).agg(*aggs)
    at = _Positions(names, i.tokenizer)
    own = {f"_f{k}": at.only(only).times(p, weight) for k, (p, only) in enumerate(found)}
    seen = {f"_n{k}": p.column(at.only(only)) for k, (p, only) in enumerate(found)}
    rows = rows.select(*entity.key, match.column(at).alias("_hit"), *[v.alias(n) for n, v in (own | seen).items()])
    n_rows, mean = lengths.agg(F.count("*"), F.avg("tokens")).first()
    counts = list(rows.agg(*[F.count_if(n) for n in seen]).first()) if seen else []
    rank = _bm25(n_rows, mean or 1.0, counts, [F.col(f) for f in own], F.col("tokens"))
    return rows.filter("_hit").join(lengths, list(entity.key)).select(*entity.key, rank.alias("rank"))


def refreshed_postings(stored: DataFrame, old: DataFrame, new: DataFrame, entity: Entity, index: str | None = None) -> DataFrame:
    """Postings after a change of the table: only rows whose key or indexed texts changed are read again."""
    return _refreshed(postings, stored, old, new, entity, index)


def refreshed_lengths(stored: DataFrame, old: DataFrame, new: DataFrame, entity: Entity, index: str | None = None) -> DataFrame:
    """The same for the rows' lengths."""
    return _refreshed(row_lengths, stored, old, new, entity, index)


def _refreshed(make, stored: DataFrame, old: DataFrame, new: DataFrame, entity: Entity, index: str | None) -> DataFrame:
    i = entity.index(index)
    columns = [*entity.key, *(entity.column(c) for c in i.columns if entity.column(c) not in entity.key)]
    gone = old.select(*columns).exceptAll(new.select(*columns)).select(*entity.key)
    come = new.select(*columns).exceptAll(old.select(*columns))
    kept = stored.join(gone.distinct(), list(entity.key), "left_anti").select(*stored.columns)
    return kept.unionByName(make(come, entity, index))


def check_postings(stored: DataFrame, df: DataFrame, entity: Entity, index: str | None = None) -> DataFrame:
    """Rows by which stored postings differ from the table's, with ``problem``: stale or missing."""
    right = postings(df, entity, index)
    stale = stored.exceptAll(right).withColumn("problem", F.lit("stale"))
    return stale.unionByName(right.exceptAll(stored).withColumn("problem", F.lit("missing")))


def find_terms(stored: DataFrame, entity: Entity, terms: list[str], every: bool = True, index: str | None = None) -> DataFrame:
    """Keys of rows that have every one of the terms, or any of them, from postings of the index."""
    if not terms:
        raise InvalidSchema("no terms")
    asked = _Wanted({}, entity.index(index).tokenizer)
    wanted = sorted({t for x in terms for t in asked.tokens(x)})
    hit = stored.filter(F.col("term").isin(wanted)).groupBy(*entity.key).agg(F.count_distinct("term").alias("_n"))
    return (hit.filter(F.col("_n") == len(wanted)) if every else hit).select(*entity.key)
