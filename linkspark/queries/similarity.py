"""Similarities, typed features, keys, units and dates over block-joined part rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import keys, similarity, text, typed, units
from linkspark.functions.registry import SIMILARITIES, Comparison, ComparisonSpec
from linkspark.operators import classify, pairs
from linkspark.operators.scores import mean_present, mean_present_of
from linkspark.plans.staging import stage
from linkspark.queries import ORACLES, QUERIES, query, table

#: Pairs of parts of one brand and different types, with padded bigram sets.
PAIRS_SQL = """
WITH g AS (SELECT *, '#' || p_name || '#' AS pad FROM part),
h AS (SELECT *, list_distinct(list_transform(range(1, CAST(length(pad) AS BIGINT)), lambda i: substring(pad, i, 2))) AS gr FROM g),
j AS (SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, a.p_name AS n1, b.p_name AS n2, a.gr AS g1, b.gr AS g2, a.p_retailprice AS r1, b.p_retailprice AS r2, a.p_size AS z1, b.p_size AS z2, a.p_type AS t1, b.p_type AS t2
      FROM h a JOIN h b ON a.p_brand = b.p_brand AND a.p_type < b.p_type)
"""


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of the source ``p_type`` with the block key ``p_brand``."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("source"), F.col("p_partkey").alias("rec_id"), F.col("p_brand").alias("bkv"), "p_name", "p_retailprice", "p_size")


def _per_pair(name: str, value: Callable[[Column, Column], Column], sql: str | None, cols: tuple[str, str] = ("n1", "n2")) -> None:
    """Register one pair feature of the cross-source pairs of a brand, computed for groups of parts of one value and looked up while pairs of values are few enough to broadcast."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        column = {"n1": "p_name", "r1": "p_retailprice", "z1": "p_size"}[cols[0]]
        records = part_records(spark, sf_dir).select("source", "rec_id", "bkv", column)

        def sim(x: Column, y: Column) -> Column:
            return F.round(value(x, y).cast("double"), 6)

        return pairs.valued_pairs(records, column, sim).withColumnRenamed("value", "sim")

    run.__doc__ = value.__doc__
    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"{PAIRS_SQL} SELECT id_a, id_b, round(CAST({sql} AS DOUBLE), 6) AS sim FROM j"


_per_pair("SIM-01_exact", similarity.exact, "CASE WHEN n1 <> '' AND n1 = n2 THEN 1 ELSE 0 END")
_per_pair("SIM-02_jaccard", similarity.jaccard, "len(list_intersect(g1, g2)) / len(list_distinct(list_concat(g1, g2)))")
_per_pair("SIM-04_dice", similarity.dice, "2 * len(list_intersect(g1, g2)) / (len(g1) + len(g2))")
_per_pair("SIM-05_jaro", similarity.jaro, None)
_per_pair("SIM-05_jaro_standard", lambda a, b: similarity.jaro(a, b, "standard"), "jaro_similarity(n1, n2)")
_per_pair("SIM-06_jaro_winkler", similarity.jaro_winkler, None)
_per_pair(
    "SIM-07_bag",
    similarity.bag,
    """CASE WHEN n1 = n2 THEN 1 ELSE 1 - greatest(
      list_sum(list_transform(list_distinct(string_split(n1, '')), lambda c: greatest(length(n1) - length(replace(n1, c, '')) - length(n2) + length(replace(n2, c, '')), 0))),
      list_sum(list_transform(list_distinct(string_split(n2, '')), lambda c: greatest(length(n2) - length(replace(n2, c, '')) - length(n1) + length(replace(n1, c, '')), 0)))) / greatest(length(n1), length(n2)) END""",
)
_per_pair("SIM-08_edit", similarity.edit, "1 - levenshtein(n1, n2) / greatest(length(n1), length(n2))")
_per_pair("SIM-09_ratio", similarity.ratio, "CASE WHEN r1 = r2 THEN 1 WHEN r1 * r2 <= 0 THEN 0 ELSE least(r1, r2) / greatest(r1, r2) END", ("r1", "r2"))
_per_pair("FVS-01_num_equal", typed.num_equal, "CASE WHEN z1 = z2 THEN 1 ELSE 0 END", ("z1", "z2"))
_per_pair("FVS-02_norm_sim", lambda a, b: typed.norm_sim(a, b, F.lit(0.0), F.lit(50.0)), "1 - abs(abs(CAST(z1 AS DOUBLE) - z2) - 0) / 50", ("z1", "z2"))
_per_pair("FVS-03_abs_diff", typed.abs_diff, "abs(r1 - r2)", ("r1", "r2"))
_per_pair("FVS-04_letter_jaccard", typed.letter_jaccard, "len(list_intersect(list_distinct(string_split(n1, '')), list_distinct(string_split(n2, '')))) / len(list_distinct(list_concat(string_split(n1, ''), string_split(n2, ''))))")
_per_pair("FVS-05_word_jaccard", typed.word_jaccard, "len(list_intersect(list_distinct(string_split(n1, ' ')), list_distinct(string_split(n2, ' ')))) / len(list_distinct(list_concat(string_split(n1, ' '), string_split(n2, ' '))))")
_RELAXED = "least(list_sum(list_transform(list_distinct(string_split(n1, ' ')), lambda u: len(list_filter(list_distinct(string_split(n2, ' ')), lambda v: 1 - levenshtein(u, v) / greatest(length(u), length(v)) > 0.7)))), len(list_distinct(string_split(n1, ' '))), len(list_distinct(string_split(n2, ' '))))"
_per_pair("FVS-06_relaxed_jaccard", typed.relaxed_jaccard, f"{_RELAXED} / (len(list_distinct(string_split(n1, ' '))) + len(list_distinct(string_split(n2, ' '))) - {_RELAXED})")
_per_pair(
    "FVS-07_containment",
    typed.containment,
    """CASE WHEN len(list_distinct(string_split(n1, ' '))) > 1 AND len(list_distinct(string_split(n2, ' '))) > 1
      THEN len(list_intersect(list_distinct(string_split(n1, ' ')), list_distinct(string_split(n2, ' ')))) / least(len(list_distinct(string_split(n1, ' '))), len(list_distinct(string_split(n2, ' '))))
      ELSE len(list_intersect(list_distinct(string_split(n1, '')), list_distinct(string_split(n2, '')))) / least(len(list_distinct(string_split(n1, ''))), len(list_distinct(string_split(n2, '')))) END""",
)
_per_pair("FVS-08_levenshtein", typed.levenshtein_sim, "1 - levenshtein(n1, n2) / greatest(length(n1), length(n2))")
_per_pair("FVS-09_missing", typed.missing_flag, "CASE WHEN n1 IN ('', 'nan') OR n2 IN ('', 'nan') THEN 1 ELSE 0 END")
_per_pair("FVS-10_overlap", typed.overlap, "CASE WHEN n1 = n2 THEN 1 ELSE 0 END")

SPEC = ComparisonSpec([Comparison("dice", "p_name"), Comparison("word_jaccard", "p_name"), Comparison("edit", "p_name"), Comparison("ratio", "p_retailprice"), Comparison("ratio", "p_size")])
_VECTOR_SQL = f"""{PAIRS_SQL}, v AS (SELECT id_a, id_b, t1, t2, [
  CAST(2 * len(list_intersect(g1, g2)) / (len(g1) + len(g2)) AS DOUBLE),
  CAST(len(list_intersect(list_distinct(string_split(n1, ' ')), list_distinct(string_split(n2, ' ')))) / len(list_distinct(list_concat(string_split(n1, ' '), string_split(n2, ' ')))) AS DOUBLE),
  CAST(1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)) AS DOUBLE), least(r1, r2) / greatest(r1, r2), least(z1, z2) / CAST(greatest(z1, z2) AS DOUBLE)] AS f FROM j)
"""


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src_a, src_b, id_a, id_b, features)`` of part pairs: five similarities, q-gram sets made once per record."""
    return pairs.block_join(part_records(spark, sf_dir), SPEC)


def part_scores(spark: SparkSession, sf_dir: str, alike: bool = True) -> DataFrame:
    """``(task, id_a, id_b, agg_score)``: mean of the features of ``part_features``, those of names looked up by pair of names while these are few.

    Without ``alike`` only one of the records that are equal in source, block
    and all compared values takes part; no score is lost by that.
    """
    records = part_records(spark, sf_dir)
    if not alike:
        records = stage(records.groupBy(*(c for c in records.columns if c != "rec_id")).agg(F.min("rec_id").alias("rec_id")), "unlike-parts")
    of_names = [c for c in SPEC.comparisons if c.left == "p_name"]
    once = pairs.by_value(records, "p_name", lambda x, y: F.array(*(F.coalesce(SIMILARITIES[c.fn](x, y).cast("double"), F.lit(0.0)) for c in of_names)), row_bytes=96)
    if once is None:
        return pairs.block_join(records, SPEC).select(F.concat_ws("|", "src_a", "src_b").alias("task"), "id_a", "id_b", mean_present(F.col("features")).alias("agg_score"))
    coded, found, n = once
    met = pairs.meet(coded, ["code", "p_retailprice", "p_size"]).withColumn("at", F.col("a__code") * n + F.col("b__code")).join(F.broadcast(found), "at")
    each = [F.col("value")[of_names.index(c)] if c in of_names else F.coalesce(SIMILARITIES[c.fn](F.col(f"a__{c.left}"), F.col(f"b__{c.left}")).cast("double"), F.lit(0.0)) for c in SPEC.comparisons]
    names = [f"f{i}" for i in range(len(each))]  # columns of their own, so that the mean does not repeat them
    return met.select("task", "id_a", "id_b", *(x.alias(c) for x, c in zip(each, names, strict=True))).select("task", "id_a", "id_b", mean_present_of(*map(F.col, names)).alias("agg_score"))


@query("SIM-13_record_vector", _VECTOR_SQL + "SELECT id_a, id_b, CAST(i - 1 AS INTEGER) AS feature, round(f[i], 6) AS sim FROM v, (SELECT unnest(range(1, 6)) AS i)")
def record_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled comparison, one row per feature."""
    return part_features(spark, sf_dir).select("id_a", "id_b", F.posexplode("features").alias("feature", "sim")).withColumn("sim", F.round("sim", 6))


@query("CLS-01_exact", _VECTOR_SQL + "SELECT id_a, id_b FROM v WHERE list_sum(f[1:3]) = 3")
def cls_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose similarities by name are all 1."""
    return part_features(spark, sf_dir).where(classify.exact_rule(F.slice("features", 1, 3))).select("id_a", "id_b")


@query("CLS-02_mean", _VECTOR_SQL + "SELECT id_a, id_b, round(list_sum(f) / 5, 6) AS confidence FROM v WHERE list_sum(f) / 5 >= 0.8")
def cls_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose mean similarity reaches 0.8."""
    match, confidence = classify.mean_rule(0.8)
    return part_features(spark, sf_dir).where(match).select("id_a", "id_b", F.round(confidence, 6).alias("confidence"))


@query("CLS-03_min", _VECTOR_SQL + "SELECT id_a, id_b, round(list_min(f), 6) AS confidence FROM v WHERE list_min(f) >= 0.5")
def cls_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose similarities all reach 0.5."""
    match, confidence = classify.min_rule(0.5)
    return part_features(spark, sf_dir).where(match).select("id_a", "id_b", F.round(confidence, 6).alias("confidence"))


@query("CLS-04_weighted", _VECTOR_SQL + "SELECT id_a, id_b, round((3 * f[1] + f[2] + 2 * f[3] + f[4] + f[5]) / 8, 6) AS confidence FROM v WHERE (3 * f[1] + f[2] + 2 * f[3] + f[4] + f[5]) / 8 >= 0.75")
def cls_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose weighted similarity reaches 0.75."""
    match, confidence = classify.weighted_rule([3, 1, 2, 1, 1], 0.75)
    return part_features(spark, sf_dir).where(match).select("id_a", "id_b", F.round(confidence, 6).alias("confidence"))


@query("PRJ-04_agg_score", _VECTOR_SQL + "SELECT id_a, id_b, round(list_sum(f) / 5, 6) AS agg_score FROM v")
def agg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the features that are there."""
    from linkspark.operators.scores import mean_present

    return part_features(spark, sf_dir).select("id_a", "id_b", F.round(mean_present(F.col("features")), 6).alias("agg_score"))


@query("PRJ-05_no_sentinel", _VECTOR_SQL + "SELECT id_a, id_b, round(list_sum(list_transform(f, lambda x: CASE WHEN x = -1 THEN 0 ELSE x END)), 6) AS total FROM v")
def no_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the sentinel as 0, summed."""
    from linkspark.sources.features import without_sentinel

    return without_sentinel(part_features(spark, sf_dir)).select("id_a", "id_b", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    "PRJ-13_rescaled_features",
    _VECTOR_SQL + """, l AS (SELECT id_a, id_b, i, f[i] AS x FROM v, (SELECT unnest(range(1, 6)) AS i)), e AS (SELECT i, min(x) AS low, max(x) AS high FROM l GROUP BY i)
    SELECT id_a, id_b, CAST(i - 1 AS INTEGER) AS feature, round(CASE WHEN i = 5 THEN 1 - (x - low) / (high - low) ELSE (x - low) / (high - low) END, 6) AS x FROM l JOIN e USING (i)""",
)
def rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features min-max scaled, the last one reversed."""
    from linkspark.sources.features import rescaled_features

    return rescaled_features(part_features(spark, sf_dir), [4]).select("id_a", "id_b", F.posexplode("features").alias("feature", "x")).withColumn("x", F.round("x", 6))


@query("SIM-10_cosine", "SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of vectors of one label; norms are made once per vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.sqrt(similarity.dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    a, b = (v.select(F.col("vec_id").alias(f"id_{x}"), "label", F.col("embedding").alias(f"v_{x}"), F.col("norm").alias(f"n_{x}")) for x in "ab")
    return a.join(b, "label").where("id_a < id_b").select("id_a", "id_b", F.round(F.try_divide(similarity.dot(F.col("v_a"), F.col("v_b")), F.col("n_a") * F.col("n_b")), 5).alias("sim"))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


@query(
    "SIM-12_tfidf_cosine",
    """WITH d AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM benchmark),
    t AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM d) GROUP BY id, w),
    i AS (SELECT w, ln((SELECT count(*) FROM d) / count(*)) AS idf FROM t GROUP BY w),
    v AS (SELECT id, w, tf * idf AS x FROM t JOIN i USING (w)), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY id)
    SELECT a.id AS id_a, b.id AS id_b, round(sum(a.x * b.x) / (max(na.norm) * max(nb.norm)), 6) AS sim FROM v a JOIN v b ON a.w = b.w AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY a.id, b.id HAVING max(na.norm) * max(nb.norm) > 0 AND sum(a.x * b.x) > 1e-9""",
)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF cosine of benchmark items that share a word, as a join on terms."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.words(F.lower("text")).alias("ws"))
    v = text.tfidf_vectors(d, "id", F.col("ws"), text.idf_table(d, "id", F.col("ws")))
    a, b = (v.select("term", F.col("id").alias(f"id_{x}"), F.col("weight").alias(f"w_{x}"), F.col("norm").alias(f"n_{x}")) for x in "ab")
    s = a.join(b, "term").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"), (F.max("n_a") * F.max("n_b")).alias("n"))
    return s.where("n > 0 and dot > 1e-9").select("id_a", "id_b", F.round(F.col("dot") / F.col("n"), 6).alias("sim"))


@query("SIM-11_weighted_terms", """WITH d AS (SELECT item_id AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM benchmark),
    t AS (SELECT id, term, count(*) AS tf FROM d GROUP BY id, term), i AS (SELECT term, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM t GROUP BY term) SELECT id, term, round(tf * idf, 6) AS weight FROM t JOIN i USING (term)""")
def weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF times IDF of every benchmark item, in long form."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.words(F.lower("text")).alias("ws"))
    return text.tfidf_vectors(d, "id", F.col("ws"), text.idf_table(d, "id", F.col("ws"))).select("id", "term", F.round("weight", 6).alias("weight"))


# --- keys -------------------------------------------------------------------------


@query(
    "BLK-06_phonetic",
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part),
    c AS (SELECT word, translate(regexp_replace(substring(word, 2), '[^bfpvcgjkqsxzdtlmnr]', '', 'g'), 'bfpvcgjkqsxzdtlmnr', '111122222222334556') AS t FROM w),
    d AS (SELECT word, t, CASE WHEN t = '' THEN '' ELSE list_aggregate(list_filter(list_transform(range(1, CAST(length(t) AS BIGINT) + 1), lambda i: CASE WHEN i > 1 AND substring(t, i, 1) = substring(t, i - 1, 1) THEN '' ELSE substring(t, i, 1) END), lambda x: x <> ''), 'string_agg', '') END AS r FROM c)
    SELECT word, CASE WHEN word = '' THEN '' ELSE rpad(substring(substring(word, 1, 1) || r, 1, 4), 4, '0') END AS key FROM d""",
)
def phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phonetic key of every word of the part names."""
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return w.select("word", keys.phonetic(F.col("word")).alias("key"))


@query(
    "BLK-07_slk",
    """SELECT o_orderkey, substring(c_name, 2, 1) || substring(c_name, 3, 1) || substring(c_name, 5, 1) || substring(c_mktsegment, 2, 2) || strftime(o_orderdate, '%d%m%Y') || CASE WHEN o_orderstatus = 'F' THEN '2' ELSE '9' END AS slk
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def slk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage key out of customer name, segment, order date and status."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", keys.slk(F.col("c_name"), F.col("c_mktsegment"), F.date_format("o_orderdate", "d/M/yyyy"), F.lower("o_orderstatus")).alias("slk"))


@query("PRJ-06_qgrams", """WITH p AS (SELECT p_partkey, '#' || p_name || '#' AS pad FROM part)
    SELECT gram, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, CAST(length(pad) AS BIGINT)), lambda i: substring(pad, i, 2)))) AS gram FROM p) GROUP BY gram""")
def qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per distinct padded bigram."""
    return table(spark, sf_dir, "part").select(F.explode(text.qgrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("PRJ-06_qgrams_reference", """WITH p AS (SELECT '# ' || p_name || '#' AS pad FROM part)
    SELECT gram, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, CAST(length(pad) AS BIGINT)), lambda i: substring(pad, i, 2)))) AS gram FROM p) GROUP BY gram""")
def qgrams_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the padding that gives the reference features."""
    return table(spark, sf_dir, "part").select(F.explode(text.qgrams(F.col("p_name"), 2, "reference")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("PRJ-07_words", f"SELECT doc_id, len({_WORDS}) AS n_words, len(list_distinct({_WORDS})) AS n_distinct FROM documents")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_words"), F.size(text.word_set(F.col("text"))).cast("long").alias("n_distinct"))


@query("PRJ-08_idf", f"WITH d AS (SELECT doc_id, unnest(list_distinct({_WORDS.replace('coalesce(text', 'coalesce(lower(text)')})) AS term FROM documents) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM d GROUP BY term")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and ln(N / df) of every lower-cased word."""
    d = table(spark, sf_dir, "documents")
    return text.idf_table(d, "doc_id", text.words(F.lower("text"))).withColumn("idf", F.round("idf", 6))


@query("PRJ-09_term_counts", "SELECT conv_id, turn, w AS term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations) GROUP BY ALL")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts of every conversation turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.words(F.lower("text"))).alias("term"))
    return c.groupBy("conv_id", "turn", "term").agg(F.count("*").alias("tf"))


@query("PRJ-11_smooth_tfidf", """WITH d AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS ws FROM benchmark), t AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM d) GROUP BY id, w),
    i AS (SELECT w, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY w), v AS (SELECT id, w, tf * idf AS x FROM t JOIN i USING (w)), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY id)
    SELECT id, w AS term, round(x / norm, 6) AS weight FROM v JOIN n USING (id)""")
def smooth_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2-normalised TF-IDF with smooth idf over tokens of two or more word characters."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0)).alias("ws"))
    v = text.tfidf_vectors(d, "id", F.col("ws"), text.smooth_idf_table(d, F.col("ws")))
    return v.select("id", "term", F.round(F.col("weight") / F.col("norm"), 6).alias("weight"))


# --- units and dates -----------------------------------------------------------------

_UNIT_SQL = "WITH u AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN p_size || ' oz' WHEN p_partkey % 4 = 1 THEN p_size || ' lbs' WHEN p_partkey % 4 = 2 THEN p_size || ' kg' ELSE p_size || 'gr' END AS w, CASE WHEN p_partkey % 3 = 0 THEN p_size || ' mm' WHEN p_partkey % 3 = 1 THEN p_size || ' in' ELSE p_size || ' cm' END AS d FROM part)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    weight = F.when(k % 4 == 0, F.concat(z, F.lit(" oz"))).when(k % 4 == 1, F.concat(z, F.lit(" lbs"))).when(k % 4 == 2, F.concat(z, F.lit(" kg"))).otherwise(F.concat(z, F.lit("gr")))
    width = F.when(k % 3 == 0, F.concat(z, F.lit(" mm"))).when(k % 3 == 1, F.concat(z, F.lit(" in"))).otherwise(F.concat(z, F.lit(" cm")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", weight.alias("w"), width.alias("d"))


@query("SCL-01_pounds", _UNIT_SQL + " SELECT p_partkey, CASE WHEN w LIKE '%oz%' THEN printf('%.2f', p_size / 16) WHEN w LIKE '%lbs%' THEN CAST(p_size AS VARCHAR) ELSE 'Invalid' END AS pounds FROM u")
def scl_pounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in pounds."""
    return _units(spark, sf_dir).select("p_partkey", units.pounds(F.col("w")).alias("pounds"))


@query("SCL-05_grams", _UNIT_SQL + " SELECT p_partkey, round(CASE WHEN w LIKE '%oz%' THEN p_size * 28.3495 WHEN w LIKE '%lb%' THEN p_size * 453.592 WHEN w LIKE '%kg%' THEN p_size * 1000 ELSE p_size END, 4) AS grams FROM u".replace("p_size * 28.3495", "CAST(p_size AS DOUBLE) * 28.3495").replace("p_size * 453.592", "CAST(p_size AS DOUBLE) * 453.592"))
def scl_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in grams."""
    return _units(spark, sf_dir).select("p_partkey", F.round(units.grams(F.col("w")), 4).alias("grams"))


@query("SCL-09_centimetres", _UNIT_SQL + " SELECT p_partkey, round(CASE WHEN d LIKE '%mm%' THEN CAST(p_size AS DOUBLE) / 10 WHEN d LIKE '%in%' THEN CAST(p_size AS DOUBLE) * 2.54 ELSE p_size END, 4) AS cm FROM u")
def scl_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in centimetres."""
    return _units(spark, sf_dir).select("p_partkey", F.round(units.to_cm(F.col("d")), 4).alias("cm"))


@query("SCL-08_mm_to_cm", _UNIT_SQL + " SELECT p_partkey, CASE WHEN d LIKE '%cm%' THEN CAST(p_size AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / 10 END AS cm FROM u")
def scl_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of millimetres in centimetres."""
    return _units(spark, sf_dir).select("p_partkey", units.mm_to_cm(F.col("d")).alias("cm"))


@query("PRJ-14_common_unit", _UNIT_SQL + """, c AS (SELECT regexp_extract(w, '([a-z]+)$', 1) AS unit, count(*) AS n FROM u GROUP BY unit), m AS (SELECT unit FROM c WHERE unit IN ('g', 'kg', 'oz', 'lbs') ORDER BY n DESC, unit LIMIT 1)
    SELECT p_partkey, round(CAST(p_size AS DOUBLE) * CASE regexp_extract(w, '([a-z]+)$', 1) WHEN 'oz' THEN 28.3495 WHEN 'lbs' THEN 453.592 WHEN 'kg' THEN 1000 END / CASE (SELECT unit FROM m) WHEN 'oz' THEN 28.3495 WHEN 'lbs' THEN 453.592 WHEN 'kg' THEN 1000 ELSE 1 END, 4) AS weight FROM u""")
def common_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in the most common known unit; other texts have none."""
    u = _units(spark, sf_dir)
    known = u.select(units.unit_of(F.col("w")).alias("unit")).where(F.col("unit").isin(*units.FACTORS))
    unit = known.groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").first()["unit"]
    return u.select("p_partkey", F.round(units.to_unit(F.col("w"), unit), 4).alias("weight"))


@query("SCL-06_dimension_part", "SELECT p_partkey, p_size || ' cm' AS width, CAST(p_size + 1 AS VARCHAR) AS height FROM part".replace("p_size || ' cm' AS width", "CAST(p_size AS VARCHAR) AS width"))
def dimension_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of ``AxBxC cm``."""
    z = F.col("p_size")
    t = F.concat_ws("x", z.cast("string"), (z + 1).cast("string"), F.concat((z + 2).cast("string"), F.lit(" cm")))
    return table(spark, sf_dir, "part").select("p_partkey", units.dimension_part(t, 0).alias("width"), units.dimension_part(t, 1).alias("height"))


@query("SCL-07_resolution", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS x, CAST(p_size * 2 AS VARCHAR) AS y FROM part")
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of ``AxB``."""
    t = F.concat_ws("x", F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", units.resolution_part(t, "x").alias("x"), units.resolution_part(t, "y").alias("y"))


@query("SCL-10_dimensions", "SELECT p_partkey, p_size || '.5' AS d, CAST(p_size + 1 AS VARCHAR) AS w, CAST(p_size + 2 AS VARCHAR) AS h FROM part")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, width and height out of free text."""
    z = F.col("p_size")
    t = F.concat(z.cast("string"), F.lit('.5" d x '), (z + 1).cast("string"), F.lit(" w by "), (z + 2).cast("string"), F.lit("h"))
    m = units.dimensions(t)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.element_at(m, k).alias(k) for k in "dwh"))


@query("SCL-11_sensor", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'CMOS' WHEN p_partkey % 4 = 1 THEN 'MOS' WHEN p_partkey % 4 = 2 THEN 'CCD' END AS sensor FROM part")
def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor type out of free text."""
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, "a CMOS chip").when(k % 4 == 1, "MOS").when(k % 4 == 2, "old CCD").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", units.sensor(t).alias("sensor"))


@query("SCL-12_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five ways and read back."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MMMM d, yyyy")
    t = F.when(k % 4 == 0, F.date_format(d, forms[0])).when(k % 4 == 1, F.date_format(d, forms[1])).when(k % 4 == 2, F.date_format(d, forms[2])).otherwise(F.date_format(d, forms[3]))
    return table(spark, sf_dir, "orders").select("o_orderkey", units.parse_date(t).cast("string").alias("day"))


@query("SCL-13_is_date", "SELECT o_orderkey, o_orderkey % 2 = 0 AS is_date FROM orders")
def is_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is a date."""
    t = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", units.is_date(t).alias("is_date"))


@query("SCL-14_seconds", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 60 + 7 WHEN p_partkey % 3 = 1 THEN p_size * 60 + 7 ELSE (100000 + p_size) / 1000 END AS DOUBLE) AS sec FROM part")
def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of three notations in seconds."""
    k, z = F.col("p_partkey"), F.col("p_size")
    t = F.when(k % 3 == 0, F.concat(z.cast("string"), F.lit(":07"))).when(k % 3 == 1, F.concat(z.cast("string"), F.lit("m 07sec"))).otherwise((z + 100000).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", units.seconds(t).alias("sec"))


@query("SCL-02_first_present", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, p_partkey) AS v FROM part")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value that is there; also the rule for dimension columns."""
    return table(spark, sf_dir, "part").select("p_partkey", units.first_present(F.when(F.col("p_size") > 25, F.col("p_size").cast("long")), F.col("p_partkey")).alias("v"))


@query("SCL-03_clean_number", "SELECT o_orderkey, CAST(regexp_replace(o_orderpriority, '[^0-9.]', '', 'g') AS DOUBLE) AS n FROM orders")
def clean_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of texts."""
    return table(spark, sf_dir, "orders").select("o_orderkey", units.clean_number(F.col("o_orderpriority")).alias("n"))


@query("SCL-16_disagreement", "SELECT p_partkey, CAST(p_size % 2 <> p_partkey % 2 AS DOUBLE) AS score FROM part")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of a learner and of two that agree with each other."""
    k, z = (F.col("p_partkey") % 2).cast("int"), (F.col("p_size") % 2).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", units.disagreement(F.array(z, k, k)).alias("score"))


@query("FVS-13_date_diffs", "SELECT l_orderkey, l_linenumber, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS DOUBLE) AS days, CAST(abs(month(l_shipdate) - month(o_orderdate)) AS DOUBLE) AS months, CAST(abs(year(l_shipdate) - year(o_orderdate)) AS DOUBLE) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of ship and order dates."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a, b = F.col("l_shipdate"), F.col("o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", typed.day_diff(a, b).alias("days"), typed.month_diff(a, b).alias("months"), typed.year_diff(a, b).alias("years"))
