"""String, set, number and vector similarities as Column expressions.

All give 0 if either side is empty or null and 1 for equal sides, unless
stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions.text import qgrams

#: Marks a character as assigned; never part of a text.
_TAKEN = "\x01"


def _guard(a: Column, b: Column, value: Column) -> Column:
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).when(a == b, 1.0).otherwise(value)


def exact(a: Column, b: Column) -> Column:
    """1 if equal and not empty."""
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


def set_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / all_).otherwise(0.0)


def set_dice(x: Column, y: Column) -> Column:
    """Dice of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def jaccard(a: Column, b: Column, q: int = 2) -> Column:
    """Jaccard on distinct padded q-grams."""
    return _guard(a, b, set_jaccard(qgrams(a, q), qgrams(b, q)))


def dice(a: Column, b: Column, q: int = 2) -> Column:
    """Dice on distinct padded q-grams."""
    return _guard(a, b, set_dice(qgrams(a, q), qgrams(b, q)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _assigned(a: Column, b: Column, reach: Column) -> Column:
    """Characters of ``a`` that find a free partner in ``b`` within ``reach``, in order."""
    n = F.length(b)

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(a, i, F.lit(1))
        start = F.greatest(i - reach, F.lit(1))
        window = F.substring(acc["rest"], start, F.greatest(F.least(i + reach, n) - start + 1, F.lit(0)))
        at = F.instr(window, c)
        hit = at > 0
        rest = F.concat(F.substring(acc["rest"], F.lit(1), start + at - 2), F.lit(_TAKEN), F.substring(acc["rest"], start + at, n))
        return F.struct(F.when(hit, rest).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(b.alias("rest"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def jaro(a: Column, b: Column, variant: str = "reference") -> Column:
    """Jaro with a window of half the longer length less one.

    ``reference`` counts half transpositions; ``standard`` rounds them down.
    """
    n, m = F.length(a), F.length(b)
    reach = F.floor(F.greatest(n, m) / 2).cast("int") - 1

    def value(both: Column) -> Column:
        one, two = both["one"], both["two"]
        common = (F.length(one) + F.length(two)) / 2
        differ = F.aggregate(F.zip_with(F.split(one, ""), F.split(two, ""), lambda x, y: F.when((x != "") & ~x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        swaps = differ / 2 if variant == "reference" else F.floor(differ / 2)
        return F.when(common == 0, 0.0).otherwise((common / n + common / m + (common - swaps) / common) / 3)

    return _guard(a, b, _let(F.struct(_assigned(a, b, reach).alias("one"), _assigned(b, a, reach).alias("two")), value))


def jaro_winkler(a: Column, b: Column, variant: str = "reference") -> Column:
    """Jaro with a bonus of a tenth of the rest per common leading character, four at most.

    In the ``reference`` variant one character fewer counts where the shorter
    string is a prefix of the longer one.
    """
    base = jaro(a, b, variant)
    short = F.least(F.length(a), F.length(b))
    shared = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= short) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(k))
    if variant == "reference":
        whole = F.substring(a, F.lit(1), short) == F.substring(b, F.lit(1), short)
        shared = F.when(whole & (short <= 4), F.least(shared, short - 1)).otherwise(shared)
    return _guard(a, b, _let(base, lambda j: F.when(j == 0, 0.0).otherwise(j + shared * 0.1 * (1 - j))))


def bag(a: Column, b: Column) -> Column:
    """1 minus the larger one-sided difference of the character multisets over the longer length."""

    def more(x: Column, y: Column) -> Column:
        def count(s: Column, c: Column) -> Column:
            return F.length(s) - F.length(F.replace(s, c, F.lit("")))

        return F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0), lambda t, c: t + F.when(c == "", 0).otherwise(F.greatest(count(x, c) - count(y, c), F.lit(0))))

    return _guard(a, b, 1 - F.greatest(more(a, b), more(b, a)) / F.greatest(F.length(a), F.length(b)))


def edit(a: Column, b: Column) -> Column:
    """1 minus the Levenshtein distance over the longer length."""
    return _guard(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger number; 0 for missing, unequal signs or a zero."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).when(x * y <= 0, 0.0).otherwise(F.least(F.abs(x), F.abs(y)) / F.greatest(F.abs(x), F.abs(y)))


def dot(x: Column, y: Column) -> Column:
    """Inner product of two number arrays."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two number arrays; 0 for a zero norm, a missing side or not-a-number."""
    value = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def squared_distance(x: Column, y: Column) -> Column:
    """Squared Euclidean distance of two number arrays."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine_maps(x: Column, y: Column) -> Column:
    """Cosine of two term-weight maps; 0 for a zero norm."""

    def norm(m: Column) -> Column:
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))

    product = F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + F.element_at(x, k) * F.coalesce(F.try_element_at(y, k), F.lit(0.0)))
    return F.coalesce(F.try_divide(product, norm(x) * norm(y)), F.lit(0.0))
