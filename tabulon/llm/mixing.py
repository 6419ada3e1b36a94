"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token weights of the cells (source, lang, topic) are raked until no marginal is further from its
target than ``TOLERANCE``; a document is then sampled with the probability of its cell: the cell's
weight by its tokens, scaled so that the largest probability is 1. In expectation the sampled
tokens have the target marginals, as near as raking has come to them.

Scale: documents are reduced to cells with a map-side sum before anything is shuffled, and the
raking works on cells alone. Up to ``FEW_CELLS`` cells, by a count, are raked in one partition
without a shuffle and broadcast to the documents. More are raked by sums of each marginal, which
are added up before they are shuffled and joined back to the cells; then the join to the documents
shuffles too, and Spark splits a cell with many documents. Texts aren't shuffled in the first case,
and are read once for the cells and once for the sample.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.llm._store import Scratch, free_name

#: A marginal without given shares gets its tokens' shares to this power, normalised.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Raking ends when every share of a marginal is off by this part of its target at most, or after
#: so many rounds, with a warning: then the targets contradict each other or the empty cells.
TOLERANCE = 1e-3
MOST_ROUNDS = 400
#: Rounds between two looks at the marginals.
ROUNDS_PER_LOOK = 4
#: Cells up to so many are raked in one partition and broadcast (under 100 bytes each).
FEW_CELLS = 50_000
#: Stems by topic, in English, French, German and Spanish, for documents without a column ``topic``.
TOPICS = {
    "law": ("attorney", "avocat", "contract", "copyright", "court", "gericht", "gesetz", "judge", "juge", "law", "legal", "licen", "lizenz", "tribunal", "vertrag", "warrant"),
    "business": ("bank", "business", "commerce", "compan", "econom", "empresa", "entreprise", "finan", "handel", "invest", "market", "mercado", "price", "unternehmen", "wirtschaft"),
    "computing": ("algorithm", "api", "code", "comput", "datei", "fichier", "hardware", "informati", "internet", "logiciel", "password", "program", "rechner", "server", "software"),
    "science": ("astronom", "atom", "biolog", "chem", "cienc", "energ", "experiment", "forschung", "laborator", "math", "physi", "research", "scien", "theor", "wissenschaft"),
    "health": ("arzt", "cancer", "disease", "doctor", "enfermedad", "gesund", "health", "hospital", "kranken", "maladie", "medic", "patient", "salud", "therap", "vaccin"),
    "sport": ("athlet", "baseball", "basketball", "campeon", "championn", "coach", "football", "futbol", "league", "mannschaft", "olympi", "player", "spieler", "sport", "tennis"),
    "arts": ("album", "artist", "cinema", "film", "galer", "kunst", "litera", "museo", "museum", "music", "musik", "musique", "novel", "poem", "theat"),
    "politics": ("congress", "democra", "election", "gobierno", "gouvern", "govern", "minist", "parlament", "parliament", "partei", "polit", "presiden", "regierung", "senat", "vote"),
}
#: The topic of a text with no word that begins with one of these.
NO_TOPIC = "general"


def _stem_pattern() -> str:
    """What finds a word's beginning that is one of the stems, its first letter in either case, tried by first letters."""
    by_first: dict[str, list[str]] = {}
    for stem in sorted({t for own in TOPICS.values() for t in own}):
        by_first.setdefault(stem[0], []).append(stem[1:])
    return r"(?:^|[^\p{L}])(" + "|".join(f"[{c.upper()}{c}](?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


STEM = _stem_pattern()


def tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The topic with the most words that begin with one of its stems, of equals the first in ``TOPICS``; else ``NO_TOPIC``."""

    def count(stems: Column, own: tuple[str, ...]) -> Column:
        return F.size(F.filter(stems, lambda t: F.lower(t).isin(*own)))

    def most(stems: Column) -> Column:
        counts = [F.struct(count(stems, own).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("topic")) for i, (name, own) in enumerate(TOPICS.items())]
        return F.array_max(F.array(*counts, F.struct(F.lit(0).alias("n"), F.lit(1).alias("place"), F.lit(NO_TOPIC).alias("topic"))))

    # the texts are searched once, since the lambda's argument is a value
    stems = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STEM), F.lit(1))
    return F.transform(F.array(stems), most)[0]["topic"]


def _described(docs: DataFrame) -> Column:
    """A struct of each row's tokens, source, lang and topic; null counts as the value ''."""
    n = tokens(docs["text"])

    def value(c: str) -> Column:
        return F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("")

    about = value("topic") if "topic" in docs.columns else topic(docs["text"])
    return F.struct(n.alias("tokens"), value("source").alias("source"), value("lang").alias("lang"), about.alias("topic"))


def _with_targets(work: Scratch, cells: DataFrame, given: dict[str, dict[str, float]], few: bool) -> DataFrame:
    """``cells`` with the share of each marginal that its value is to have, as want_source and so on."""
    for dim in POWERS:
        t = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("want"))
        if dim in given:
            shares = work.spark.createDataFrame([(k, float(v)) for k, v in given[dim].items()], f"{dim} string, want double")
            t = t.select(dim).join(shares, dim, "left").select(dim, F.coalesce("want", F.lit(0.0)).alias("want"))
            power = 1.0
        else:
            power = POWERS[dim]
        t = work.saved(t, f"want-{dim}")
        total = float(t.agg(F.sum("want")).first()[0] or 1)
        t = t.withColumn("want", F.pow(F.col("want") / F.lit(total), F.lit(power)))
        total = float(t.agg(F.sum("want")).first()[0] or 1)
        t = t.select(dim, (F.col("want") / F.lit(total)).alias(f"want_{dim}"))
        cells = cells.join(F.broadcast(t) if few else t, dim)
    return work.saved(cells, "cells")


def _round(work: Scratch, cur: DataFrame, few: bool) -> DataFrame:
    """The cells with weights that are scaled to each marginal in turn."""
    for dim in POWERS:
        if few:
            cur = cur.withColumn("have", F.sum("weight").over(Window.partitionBy(dim)))
        else:
            cur = work.saved(cur.join(cur.groupBy(dim).agg(F.sum("weight").alias("have")), dim), f"by-{dim}")
        cur = cur.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"want_{dim}"), F.col("have")), F.lit(0.0))).drop("have")
    return cur


def _deviation(cur: DataFrame) -> float:
    """The largest part of its target by which a share of a marginal is off."""
    off = None
    for dim in POWERS:
        have = cur.groupBy(dim).agg(F.sum("weight").alias("have"), F.max(f"want_{dim}").alias("want")).filter("want > 0")
        own = have.select((F.abs(F.col("have") - F.col("want")) / F.col("want")).alias("off"))
        off = own if off is None else off.unionAll(own)
    return float(off.agg(F.max("off")).first()[0] or 0.0)


def rake(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, docs, weight, probability, deviation) of each cell with tokens.

    ``deviation``, the same in each row, is the largest part of its target by which a share of a
    marginal is off in the end. It is above ``tolerance`` only after ``most_rounds``, with a warning.
    """
    work = Scratch(docs.sparkSession, "op7")
    d = docs.select(_described(docs).alias("d"))
    cells = work.saved(d.groupBy("d.source", "d.lang", "d.topic").agg(F.sum("d.tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0"), "counts")
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(1))).first()
    few = n <= FEW_CELLS
    cells = cells.coalesce(1) if few else cells
    cur = _with_targets(work, cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), targets or {}, few)
    rounds, off = 0, 0.0
    while n:
        for _ in range(ROUNDS_PER_LOOK):
            cur = _round(work, cur.coalesce(1) if few else cur, few)
        cur = work.saved(cur, "raked")
        rounds, off = rounds + ROUNDS_PER_LOOK, _deviation(cur)
        if off <= tolerance:
            break
        if rounds >= most_rounds:
            warnings.warn(f"after {rounds} rounds a marginal is off by {off:.3g} of its target", stacklevel=2)
            break
    per_token = F.col("weight") / F.col("tokens")
    weight, most = cur.agg(F.sum("weight"), F.max(per_token)).first()
    share = F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
    out = cur.select("source", "lang", "topic", "tokens", "docs", share.alias("weight"), (per_token / F.lit(most) if most else F.lit(0.0)).alias("probability"), F.lit(off).alias("deviation"))
    return work.result(out, "op7-cells")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_probability(docs: DataFrame, targets, tolerance: float, seed: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of what is known of each row, and that column's name."""
    cells = rake(docs, targets, tolerance)
    few = cells.count() <= FEW_CELLS
    own = free_name(docs.columns, "_mix")
    p = cells.select(F.struct("source", "lang", "topic").alias(f"{own}_cell"), F.col("probability").alias(f"{own}_p"))
    out = docs.withColumn(own, _described(docs))
    out = out.join(F.broadcast(p) if few else p, F.struct(*[F.col(f"{own}.{c}") for c in POWERS]) == p[f"{own}_cell"], "left")
    known = F.struct(f"{own}.*", F.coalesce(p[f"{own}_p"], F.lit(0.0)).alias("probability"), draw(docs["doc_id"], seed).alias("draw"))
    return out.select(*[docs[c] for c in docs.columns], known.alias(own)), own


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, n_tokens, probability, sampled.

    ``targets`` gives shares of tokens by value for any of source, lang and topic; values not
    named get none; a marginal not given gets its shares to the power in ``POWERS``. Nulls are a
    value of their own, returned as ''. Without a column ``topic`` it is read from the text, by the
    stems in ``TOPICS``. Texts without words add no weight and share the probability of their cell; a cell
    without words isn't sampled. Rows that repeat a doc_id share its draw. Other columns aren't read; an empty table gives an empty result.
    """
    got, own = _with_probability(docs.select([c for c in ("doc_id", "text", "source", "lang", "topic") if c in docs.columns]), targets, tolerance, seed)
    return got.select(
        "doc_id",
        *[F.col(f"{own}.{c}").alias(c) for c in POWERS],
        F.col(f"{own}.tokens").alias("n_tokens"),
        F.round(f"{own}.probability", 9).alias("probability"),
        (F.col(f"{own}.draw") < F.col(f"{own}.probability")).alias("sampled"),
    )


def keep_sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the mix samples."""
    got, own = _with_probability(docs, targets, tolerance, seed)
    return got.filter(F.col(f"{own}.draw") < F.col(f"{own}.probability")).drop(own)


def mix_sql(table: str = "documents", tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, seed: int = 7) -> str:
    """DuckDB SQL for the rows of ``mix`` with its default targets, for a table without a column ``topic``."""
    counts = {name: f"len(list_filter(stems, lambda t: lower(t) IN ({', '.join(repr(t) for t in own)})))" for name, own in TOPICS.items()}
    most = f"greatest({', '.join(counts.values())})"
    cases = f"CASE WHEN len(stems) = 0 THEN '{NO_TOPIC}' " + " ".join(f"WHEN {n} = {most} THEN '{name}'" for name, n in counts.items()) + " END"
    keys = ", ".join(POWERS)
    ctes = [
        rf"d0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n, "
        f"regexp_extract_all(coalesce(text, ''), '{STEM}', 1) AS stems FROM {table})",
        f"d AS (SELECT doc_id, source, lang, n, {cases} AS topic FROM d0)",
        f"c AS (SELECT {keys}, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for dim, power in POWERS.items():
        ctes.append(f"s_{dim} AS (SELECT {dim}, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {power}) AS r FROM c GROUP BY {dim})")
        ctes.append(f"w_{dim} AS (SELECT {dim}, r / sum(r) OVER () AS want_{dim} FROM s_{dim})")
    wants = ", ".join(f"want_{dim}" for dim in POWERS)
    joins = " ".join(f"JOIN w_{dim} USING ({dim})" for dim in POWERS)
    step = "r"
    for _ in range(ROUNDS_PER_LOOK):
        for dim in POWERS:
            step = f"(SELECT {keys}, tokens, {wants}, k, off, weight * want_{dim} / sum(weight) OVER (PARTITION BY k, {dim}) AS weight FROM {step} WHERE k < {most_rounds} AND off > {tolerance})"
    off = "greatest(" + ", ".join(f"max(abs(sum_{dim} - want_{dim}) / want_{dim}) OVER ()" for dim in POWERS) + ")"
    sums = ", ".join(f"sum(weight) OVER (PARTITION BY {dim}) AS sum_{dim}" for dim in POWERS)
    ctes.append(
        f"r AS (SELECT {keys}, tokens, {wants}, 0 AS k, CAST('infinity' AS DOUBLE) AS off, tokens / sum(tokens) OVER () AS weight FROM c {joins} "
        f"UNION ALL SELECT {keys}, tokens, {wants}, k + {ROUNDS_PER_LOOK}, {off}, weight FROM (SELECT *, {sums} FROM {step}))"
    )
    ctes.append(f"p AS (SELECT {keys}, weight / tokens / max(weight / tokens) OVER () AS p FROM r WHERE k = (SELECT max(k) FROM r))")
    return (
        "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n AS n_tokens, round(coalesce(p.p, 0), 9) AS probability, "
        f"CAST('0x' || substr(md5('{seed}:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(p.p, 0) AS sampled "
        "FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"
    )
