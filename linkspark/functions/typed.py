"""Typed pair features; a missing side (null, empty or the text ``nan``) gives -1 unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions import similarity


def missing(c: Column) -> Column:
    """Null, empty or ``nan``."""
    return F.coalesce(c.cast("string").isin("", "nan"), F.lit(True))


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(missing(a) | missing(b), -1.0).otherwise(value.cast("double"))


def _numbers(a: Column, b: Column, value) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(missing(a) | missing(b) | x.isNull() | y.isNull(), -1.0).otherwise(value(x, y).cast("double"))


def _letters(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def num_equal(a: Column, b: Column) -> Column:
    """1 if the numbers are equal, else 0."""
    return _numbers(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))


def norm_sim(a: Column, b: Column, low: Column, high: Column) -> Column:
    """1 minus the offset of the distance from ``low`` over the range of distances; -1 for an empty range."""
    return _numbers(a, b, lambda x, y: F.coalesce(1 - F.try_divide(F.abs(F.abs(x - y) - low), high - low), F.lit(-1.0)))


def abs_diff(a: Column, b: Column) -> Column:
    """Absolute difference."""
    return _numbers(a, b, lambda x, y: F.abs(x - y))


def letter_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of characters."""
    return _both(a, b, similarity.set_jaccard(_letters(a), _letters(b)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of blank-separated words."""
    return _both(a, b, similarity.set_jaccard(_words(a), _words(b)))


def relaxed_jaccard(a: Column, b: Column, alike: float = 0.7) -> Column:
    """Word Jaccard in which words match above an edit similarity; matches are capped at the smaller set. 0 if neither has a word."""
    x, y = _words(a), _words(b)
    hits = F.aggregate(x, F.lit(0), lambda s, u: s + F.size(F.filter(y, lambda v: (u == v) | (1 - F.levenshtein(u, v) / F.greatest(F.length(u), F.length(v), F.lit(1)) > alike))))
    shared = F.least(hits, F.size(x), F.size(y))
    return _both(a, b, F.coalesce(F.try_divide(shared, F.size(x) + F.size(y) - shared), F.lit(0.0)))


def containment(a: Column, b: Column, letters: bool = True) -> Column:
    """Shared over the smaller set: of words if both have several (or ``letters`` is off), else of characters."""
    x, y, u, v = _words(a), _words(b), _letters(a), _letters(b)
    of_words = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    of_letters = F.size(F.array_intersect(u, v)) / F.least(F.size(u), F.size(v))
    several = (F.size(x) > 1) & (F.size(y) > 1)
    return _both(a, b, F.when(several | F.lit(not letters), of_words).otherwise(of_letters))


def levenshtein_sim(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    return _both(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def missing_flag(a: Column, b: Column) -> Column:
    """1 if either side is missing, else 0."""
    return F.when(missing(a) | missing(b), 1.0).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """1 if equal, else 0."""
    return _both(a, b, F.when(a == b, 1.0).otherwise(0.0))


def day_diff(a: Column, b: Column) -> Column:
    """Days between two dates (own definition)."""
    return F.coalesce(F.abs(F.datediff(a, b)).cast("double"), F.lit(-1.0))


def month_diff(a: Column, b: Column) -> Column:
    """Distance of the months' numbers (own definition)."""
    return F.coalesce(F.abs(F.month(a) - F.month(b)).cast("double"), F.lit(-1.0))


def year_diff(a: Column, b: Column) -> Column:
    """Distance of the years (own definition)."""
    return F.coalesce(F.abs(F.year(a) - F.year(b)).cast("double"), F.lit(-1.0))
