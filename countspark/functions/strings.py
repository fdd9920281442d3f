"""String similarity in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    return F.lower(c.cast("string"))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two strings of one length; null where the lengths differ or one is null."""
    apart = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(apart, F.lit(0), lambda s, x: s + x)).cast("long")


def ngrams(c: Column, n: int = 3) -> Column:
    """The distinct n-grams of a string; a shorter string is its own only one."""
    last = F.length(c) - F.lit(n - 1)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(cut)


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of n-grams."""
    x, y = ngrams(a, n), ngrams(b, n)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")


def token_hash(key: str, value: Column) -> Column:
    """A keyed digest by which equal values can be matched without being read."""
    return F.sha2(F.concat(F.lit(key), F.lit(":"), normalised(value)), 256)
