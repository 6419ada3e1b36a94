"""Tokens of text columns, as columns, and the same rules in Python for query texts."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.porter import stem
from tabulon.shipping import ship


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, str]:
    """Letters that decompose to a base letter and marks, their base letters, and all marks."""
    pairs, marks = [], []
    for cp in range(0xC0, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)[0]
        if kind == "M":
            marks.append(ch)
        elif kind == "L" and cp < 0x10000 and not 0xAC00 <= cp <= 0xD7A3:
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
                pairs.append((ch, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), "".join(marks)


def fold(c: Column) -> Column:
    """Lower case without diacritics, in one pass: what has no counterpart is deleted. Texts of ASCII alone take the short way."""
    letters, bases, marks = fold_table()
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, letters + marks, bases)).otherwise(low)


def fold_text(s: str) -> str:
    return s.lower().translate(str.maketrans(*fold_table()))


def tokens_of_text(s: str) -> list[str]:
    """The tokens of a query text."""
    return "".join(x if unicodedata.category(x)[0] in "LN" else " " for x in fold_text(s)).split()


@F.pandas_udf(T.StringType())
def _stem_all(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(map(stem, x.split(" "))))


def padded_tokens(c: Column, tokenizer: str = "unicode") -> Column:
    """Tokens with a space before and after each, so that a phrase is a substring; one space without tokens, as for null."""
    padded = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(fold(c), F.lit("")), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    if tokenizer != "porter":
        return padded
    ship(SparkSession.active())
    return _stem_all(padded)


def token_count(padded: Column) -> Column:
    """How many tokens a padded string has."""
    return F.regexp_count(padded, F.lit(" ")) - 1


def occurrences(padded: Column, tokens: list[str], prefix: bool = False) -> Column:
    """How often consecutive tokens occur, overlapping ones included; of a prefix the last one only begins so."""
    head, *rest = tokens
    ahead = "".join(f" {t}" for t in rest) + ("" if prefix else " ")
    return F.regexp_count(padded, F.lit(f" {head}(?={ahead})" if ahead else f" {head}"))


def tokens(c: Column, tokenizer: str = "unicode") -> Column:
    """The tokens of a text as an array."""
    return F.filter(F.split(padded_tokens(c, tokenizer), " "), lambda t: t != "")
