"""Weights, dimensions, durations and dates out of free text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date patterns that are tried in order (fixed values).
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MMMM d, yyyy", "yyyy")


def _number(c: Column) -> Column:
    return F.split(c, " ")[0].try_cast("double")


def _has(c: Column, *texts: str) -> Column:
    low = F.lower(c)
    found = F.contains(low, F.lit(texts[0]))
    for t in texts[1:]:
        found = found | F.contains(low, F.lit(t))
    return found


def pounds(c: Column) -> Column:
    """Ounces to pounds with two decimals, pounds without their unit, ``Invalid`` otherwise."""
    return F.when(c.isNull(), None).when(_has(c, "oz"), F.format_string("%.2f", F.bround(_number(c) / 16, 2))).when(_has(c, "lbs"), F.split(c, " ")[0]).otherwise("Invalid")


def grams(c: Column) -> Column:
    """Ounces, pounds and kilograms to grams; other texts without ``gr``, as a number if they are one."""
    return F.when(_has(c, "oz"), _number(c) * 28.3495).when(_has(c, "lb", "pounds"), _number(c) * 453.592).when(_has(c, "kg"), _number(c) * 1000).otherwise(F.trim(F.regexp_replace(c, r'gr|"|\\', "")).try_cast("double"))


def first_present(*cols: Column) -> Column:
    """First value that is there."""
    return F.coalesce(*cols)


def clean_number(c: Column) -> Column:
    """The number that is left without other characters."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")


def dimension_part(c: Column, n: int) -> Column:
    """Part ``n`` of ``AxBxC``: as it is for cm, with unit for mm (of three parts at least), else ``Invalid``."""
    parts = F.split(F.trim(F.replace(c, F.lit("″"), F.lit(""))), "x")
    part = F.get(parts, F.lit(n))
    return F.when(c.isNull(), None).when(F.contains(c, F.lit("cm")), part).when(F.contains(c, F.lit("mm")), F.when(F.size(parts) >= 3, F.concat(part, F.lit(" mm")))).otherwise("Invalid")


def resolution_part(c: Column, axis: str) -> Column:
    """Width (``x``) or height of ``AxB``."""
    return F.get(F.split(c, "x"), F.lit(0 if axis == "x" else 1))


def mm_to_cm(c: Column) -> Column:
    """First whole number over ten; the first token if in cm; 0 without a digit."""
    return F.when(c.isNull(), None).when(F.contains(c, F.lit("cm")), F.split(c, " ")[0].try_cast("double")).when(~c.rlike(r"\d"), 0.0).otherwise(F.regexp_extract(c, r"\d+", 0).cast("double") / 10)


def to_cm(c: Column, inches: bool = False) -> Column:
    """mm, inches and cm to cm; other texts by their digits."""
    t = F.trim(c)
    return F.when(F.contains(t, F.lit("mm")), _number(t) / 10).when(F.contains(t, F.lit("in")) | F.lit(inches), _number(t) * 2.54).when(F.contains(t, F.lit("cm")), _number(t)).otherwise(clean_number(t))


def dimensions(c: Column) -> Column:
    """Map of d, w and h to the numbers in front of them; the last of each counts."""
    numbers, labels = (F.regexp_extract_all(c, F.lit(r"(\d+\.\d+|\d+)[^\d]*?(d|w|h)"), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(labels, numbers, lambda k, v: F.struct(k.alias("k"), v.alias("v")))

    def last(label: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"] == label), F.lit(-1))["v"]

    return F.create_map(*(x for k in "dwh" for x in (F.lit(k), last(k))))


def sensor(c: Column) -> Column:
    """CMOS before MOS before CCD, else null."""
    return F.when(F.contains(c, F.lit("CMOS")), "CMOS").when(F.contains(c, F.lit("MOS")), "MOS").when(F.contains(c, F.lit("CCD")), "CCD")


def parse_date(c: Column) -> Column:
    """Date by the first fitting pattern, null otherwise."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS)).cast("date")


def is_date(c: Column) -> Column:
    """Whether any pattern fits."""
    return parse_date(c).isNotNull()


def seconds(c: Column) -> Column:
    """Track duration: whole numbers of more than four digits are ms, decimals are minutes to be scaled by 100, ``M:S`` and ``Mm Ssec``."""
    t = F.trim(c)
    ms, minsec = r"^(\d+):(\d+)$", r"^(\d+)\s*m\s*(\d+)\s*sec$"

    def sixty(pattern: str) -> Column:
        return F.regexp_extract(t, pattern, 1).try_cast("double") * 60 + F.regexp_extract(t, pattern, 2).try_cast("double")

    return F.when(t.rlike(r"^\d{5,}$"), t.try_cast("double") / 1000).when(t.rlike(r"^\d+$"), t.try_cast("double")).when(t.rlike(r"^\d+\.\d+$"), t.try_cast("double") * 100).when(t.rlike(ms), sixty(ms)).when(t.rlike(minsec), sixty(minsec))


def unit_of(c: Column) -> Column:
    """The letters behind the first number."""
    return F.lower(F.regexp_extract(c, r"^\s*[\d.]+\s*([A-Za-z]+)", 1))


#: Factor to the base unit of each kind (fixed values).
FACTORS = {"g": 1.0, "kg": 1000.0, "oz": 28.3495, "lb": 453.592, "lbs": 453.592, "mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "inch": 25.4}


def to_unit(c: Column, unit: str) -> Column:
    """The number in ``unit``, from any unit of the table; null for others."""
    factor = F.create_map(*(x for k, v in FACTORS.items() for x in (F.lit(k), F.lit(v / FACTORS[unit]))))
    return F.regexp_extract(c, r"^\s*([\d.]+)", 1).try_cast("double") * F.try_element_at(factor, unit_of(c))


def disagreement(votes: Column) -> Column:
    """Of an array whose first vote is the learner's: 0 or 1 if the others agree (with it or not), else 1 minus the majority's share."""
    others = F.slice(votes, F.lit(2), F.greatest(F.size(votes) - 1, F.lit(0)))
    most = F.array_max(F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda x: x == v))))
    united = F.size(F.array_distinct(others)) == 1
    return F.when(united, F.when(F.get(others, F.lit(0)) == F.get(votes, F.lit(0)), 0.0).otherwise(1.0)).otherwise(1 - most / F.size(votes))


def in_nested(lists: Column, value: Column) -> Column:
    """Whether any inner list holds the value."""
    return F.exists(lists, lambda x: F.array_contains(x, value))
