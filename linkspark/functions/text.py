"""Tokens, q-grams, term maps and TF-IDF weights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The padding that gives the reference features: a hash and a blank in front,
#: hashes behind, so that the empty string has two grams and equals itself.
PADDINGS = ("symmetric", "reference", "none")


def qgrams(c: Column, q: int = 2, padding: str = "symmetric") -> Column:
    """Distinct q-grams. ``symmetric``: hashes on both sides, none for empty or null; ``reference``: see PADDINGS."""
    if padding == "reference":
        text = F.concat(F.lit("# " * (q - 1)), F.coalesce(c, F.lit("")), F.lit("#" * (q - 1)))
    elif padding == "symmetric":
        text = F.concat(F.lit("#" * (q - 1)), c, F.lit("#" * (q - 1)))
    else:
        text = c
    n = F.length(text) - (q - 1)
    grams = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    if padding == "reference":
        return F.array_distinct(grams)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def words(c: Column, pattern: str = r"\s+") -> Column:
    """Non-empty tokens between matches of ``pattern``."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), pattern), lambda w: w != "")


def word_set(c: Column, pattern: str = r"\s+") -> Column:
    """Distinct tokens."""
    return F.array_distinct(words(c, pattern))


def tf_map(tokens: Column) -> Column:
    """Term to count, as a map."""
    return F.map_from_entries(F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.size(F.filter(tokens, lambda x: x == t)))))


def idf_table(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``(term, df, idf)`` with idf = ln(N / df); every term counts once per record. Map-side combined."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))


def smooth_idf_table(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1 + N) / (1 + df)) + 1, the usual vectoriser default."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)


def tfidf_vectors(docs: DataFrame, id_col: str, tokens: Column, idf: DataFrame) -> DataFrame:
    """``(id, term, weight, norm)``: tf x idf in long form with the L2 norm of each record. Terms without idf are dropped."""
    tf = docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    weighted = tf.join(idf.select("term", "idf"), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, "id")


def weigh(tf: Column, idf: Column) -> Column:
    """A term-count map times an idf map; terms without idf are dropped."""
    return F.transform_values(F.map_filter(tf, lambda t, _: F.map_contains_key(idf, t)), lambda t, n: n * F.element_at(idf, t))


def flatten_property(c: Column) -> Column:
    """One value of a bracketed list property: brackets cut, first of the comma-separated parts, signs to blanks, ``null`` to empty."""
    first = F.split(F.regexp_replace(c, r"[\[\]]", ""), ",", 2)[0]
    plain = F.trim(F.regexp_replace(first, r"[^A-Za-z0-9]+", " "))
    return F.when(c.isNull() | (plain == "null"), "").otherwise(plain)


def url_domain(c: Column) -> Column:
    """Scheme and host of a url that goes on with ``/`` or ``?``; null for others."""
    found = F.regexp_extract(c, r"https?://[^/]+(?=/|\?)", 0)
    return F.when(found != "", found)


def attribute_of(feature: Column, attributes: list[str]) -> Column:
    """The longest attribute that a feature's name begins with; null if there is none."""
    return F.coalesce(*(F.when(F.startswith(feature, F.lit(a)), a) for a in sorted(attributes, key=len, reverse=True)))
