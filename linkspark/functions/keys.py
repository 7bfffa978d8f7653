"""Blocking keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Consonant classes of the phonetic key (fixed values).
_LETTERS = "bfpvcgjkqsxzdtlmnr"
_CODES = "111122222222334556"


def simple(c: Column) -> Column:
    """The value itself."""
    return c


def phonetic(c: Column) -> Column:
    """First letter as it is and three consonant codes.

    Letters without a code are dropped before repeats are, so equal codes
    around a vowel collapse; unlike the standard key.
    """
    tail = F.translate(F.regexp_replace(F.substring(c, 2, 1 << 20), f"[^{_LETTERS}]", ""), _LETTERS, _CODES)
    code = F.regexp_replace(tail, r"(\d)\1+", "$1")
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.rpad(F.substring(F.concat(F.substring(c, 1, 1), code), 1, 4), 4, "0"))


def slk(family: Column, given: Column, birth: Column, sex: Column) -> Column:
    """Letters 2, 3 and 5 of the family name, 2 and 3 of the given name, ddmmyyyy of a d/m/yyyy date, and 1, 2 or 9.

    ``2`` stands for a missing letter, ``999`` and ``99`` for a missing name;
    a name of one letter contributes nothing.
    """

    def part(c: Column, places: list[int], none: str) -> Column:
        name = F.regexp_replace(c, "[-,_]", "")
        letters = F.concat(*(F.when(F.length(name) >= p, F.substring(name, p, 1)).otherwise("2") for p in places))
        return F.when(F.coalesce(c, F.lit("")) == "", none).when(F.length(name) < 2, "").otherwise(letters)

    bits = F.split(birth, "/")
    date = F.concat(F.lpad(bits[0], 2, "0"), F.lpad(bits[1], 2, "0"), bits[2])
    return F.concat(part(family, [2, 3, 5], "999"), part(given, [2, 3], "99"), F.coalesce(date, F.lit("")), F.when(sex == "m", "1").when(sex == "f", "2").otherwise("9"))


def conjunctive(*keys: Column) -> Column:
    """Keys joined without a separator, as the documented examples have it."""
    return F.concat(*(F.coalesce(k.cast("string"), F.lit("")) for k in keys))


def disjunctive(*keys: Column) -> Column:
    """One key per part, with its number in front, as an array to explode."""
    return F.array(*(F.concat(F.lit(str(i)), F.coalesce(k.cast("string"), F.lit(""))) for i, k in enumerate(keys)))
