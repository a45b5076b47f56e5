"""Full-text search over arrays of words with places: vectors, queries, rank and headline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own.
STOP = "a an and are as at be by for from in is it of on or that the this to was with".split()


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def vector(text: Column) -> Column:
    """Distinct words that aren't stop words, sorted, each with its places (from 1): a map."""
    placed = F.filter(F.transform(words(text), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("at"))), lambda x: ~x["w"].isin(STOP))
    names = F.array_sort(F.array_distinct(F.transform(placed, lambda x: x["w"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(placed, lambda x: x["w"] == n), lambda x: x["at"])))


def vector_text(v: Column) -> Column:
    """'word':1,3 'next':2"""
    return F.array_join(F.transform(F.map_entries(v), lambda e: F.concat(F.lit("'"), e["key"], F.lit("':"), F.array_join(F.transform(e["value"], lambda i: i.cast("string")), ","))), " ")


def has(v: Column, word: str) -> Column:
    return F.map_contains_key(v, F.lit(word))


def followed(v: Column, first: str, second: str, distance: int = 1) -> Column:
    """first <distance> second."""
    a, b = F.element_at(v, F.lit(first)), F.element_at(v, F.lit(second))
    return F.coalesce(F.exists(a, lambda x: F.array_contains(b, x + distance)), F.lit(False))


def rank(v: Column, asked: list[str]) -> Column:
    """Sum over the words asked for of 0.1 * (1 + 1/4 + 1/9 + ...) by their places, on the scale of the best possible."""
    total = F.lit(0.0)
    for w in asked:
        n = F.size(F.coalesce(F.element_at(v, F.lit(w)), F.array().cast("array<int>")))
        total = total + F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 0.1 / (i * i))).otherwise(0.0)
    return total / (1.64493406685 * len(asked))


def headline(text: Column, asked: list[str]) -> Column:
    """The text with the words asked for in <b> tags."""
    return F.regexp_replace(text, F.lit(r"(?i)\b(" + "|".join(asked) + r")\b"), F.lit("<b>$1</b>"))
