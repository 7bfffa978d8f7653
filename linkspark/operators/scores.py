"""Score aggregation, thresholds and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.plans.prefix import running
from linkspark.plans.staging import stage

# --- aggregated scores ----------------------------------------------------------


def mean_present(features: Column) -> Column:
    """Mean of the features that are not negative; null if none is."""
    there = F.filter(features, lambda x: x >= 0)
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))


def mean_present_of(*features: Column) -> Column:
    """``mean_present`` of separate Columns, without an array to walk through for each row."""
    there = [F.coalesce(x >= 0, F.lit(False)) for x in features]
    total = sum((F.when(t, x).otherwise(0.0) for t, x in zip(there, features, strict=True)), F.lit(0.0))
    return F.try_divide(total, sum((t.cast("int") for t in there), F.lit(0)))


def rescale(df: DataFrame, column: str) -> DataFrame:
    """Min-max scaling of one column; the two extremes are a one-row broadcast. A constant becomes 0."""
    ends = df.agg(F.min(column).alias("low__"), F.max(column).alias("high__"))
    scaled = F.coalesce(F.try_divide(F.col(column) - F.col("low__"), F.col("high__") - F.col("low__")), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("low__", "high__")


def feature_stats(pairs: DataFrame) -> DataFrame:
    """``(feature, std, density)``: sample deviation with -1 as 0, and the share of values other than -1."""
    long = pairs.select(F.posexplode("features").alias("feature", "value"))
    zeroed = F.when(F.col("value") == -1, 0.0).otherwise(F.col("value"))
    return long.groupBy("feature").agg(F.stddev_samp(zeroed).alias("std"), F.avg((F.col("value") != -1).cast("double")).alias("density"))


def score_by_deviation(pairs: DataFrame) -> DataFrame:
    """Add ``agg_score``: mean of deviation-weighted features, rescaled."""
    stats = F.broadcast(feature_stats(pairs).agg(F.map_from_entries(F.collect_list(F.struct("feature", "std"))).alias("w__")))  # one entry per feature
    value = F.aggregate(F.transform("features", lambda x, i: F.when(x == -1, 0.0).otherwise(x) * F.element_at("w__", i)), F.lit(0.0), lambda s, x: s + x) / F.size("features")
    return rescale(pairs.crossJoin(stats).withColumn("agg_score", value).drop("w__"), "agg_score")


def score_by_density(pairs: DataFrame, cosine_at: int | None = None) -> DataFrame:
    """Add ``agg_score``: mean of density-weighted features, rescaled; a tf-idf cosine at ``cosine_at`` makes half of it."""
    stats = F.broadcast(feature_stats(pairs).agg(F.map_from_entries(F.collect_list(F.struct("feature", "density"))).alias("w__")))
    others = F.transform("features", lambda x, i: F.when((x == -1) | (i == F.lit(-1 if cosine_at is None else cosine_at)), 0.0).otherwise(x * F.element_at("w__", i)))
    n = F.size("features") - (0 if cosine_at is None else 1)
    scored = rescale(pairs.crossJoin(stats).withColumn("agg_score", F.aggregate(others, F.lit(0.0), lambda s, x: s + x) / n).drop("w__"), "agg_score")
    if cosine_at is None:
        return scored
    scored = rescale(scored.withColumn("cos__", F.col("features")[cosine_at]), "cos__")
    return scored.withColumn("agg_score", 0.5 * F.col("agg_score") + 0.5 * F.col("cos__")).drop("cos__")


def score_by_best_features(pairs: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Add ``agg_score`` from each attribute's feature of largest deviation, weighted by density, rescaled."""
    stats = {r["feature"]: r for r in feature_stats(pairs).collect()}  # one row per feature
    best = [max((f for f in fs if f in stats), key=lambda f: (stats[f]["std"] or 0, -f)) for fs in groups.values() if any(f in stats for f in fs)]
    value = sum((F.when(F.col("features")[f] == -1, 0.0).otherwise(F.col("features")[f] * stats[f]["density"]) for f in best), F.lit(0.0)) / max(1, len(best))
    return rescale(pairs.withColumn("agg_score", value), "agg_score")


# --- thresholds -------------------------------------------------------------------


def threshold_scan(scored: DataFrame, score: str, label: str) -> DataFrame:
    """``(threshold, fp, fn, errors)`` for 0, 0.01 .. 1: scores are counted once per hundredth, so the rows are read once."""
    cut = F.floor(F.round(F.col(score) * 100, 9)).cast("int")
    per = scored.where(F.col(score).isNotNull()).groupBy(F.greatest(F.lit(-1), F.least(F.lit(100), cut)).alias("c")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    steps = scored.sparkSession.range(101).select(F.col("id").cast("int").alias("t"))
    joined = steps.join(F.broadcast(per), F.lit(True), "left")  # 101 thresholds by at most 102 counts
    out = joined.groupBy("t").agg(F.coalesce(F.sum(F.when(F.col("c") >= F.col("t"), F.col("neg"))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(F.col("c") < F.col("t"), F.col("pos"))), F.lit(0)).alias("fn"))
    return out.select((F.col("t") / 100).alias("threshold"), "fp", "fn", (F.col("fp") + F.col("fn")).alias("errors"))


def _numbered(scores: DataFrame, score: str) -> DataFrame:
    """Distinct scores ``s`` with ``first``, the place of their first copy in ascending order, and ``after``, that behind the last."""
    counts = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"))
    return running(counts, "s", ["n"]).select("s", "n", (F.col("run_n") - F.col("n")).alias("first"), F.col("run_n").alias("after"))


def elbow(scores: DataFrame, score: str) -> DataFrame:
    """One row ``threshold``: the sorted score furthest from the line between the first and the last; the first of equals."""
    num = _numbered(scores, score)
    ends = num.agg(F.min("s").alias("y0"), F.max("s").alias("y1"), F.max("after").alias("total"))
    both = num.crossJoin(F.broadcast(ends)).select("*", F.explode(F.array_distinct(F.array("first", F.col("after") - 1))).alias("x"))
    dx, dy = F.col("total") - 1, F.col("y1") - F.col("y0")
    far = F.coalesce(F.try_divide(F.abs(dx * (F.col("s") - F.col("y0")) - dy * F.col("x")), F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    return both.agg(F.max_by("s", F.struct(F.round(far, 12), -F.col("x"))).alias("threshold"))


def histogram_threshold(scores: DataFrame, score: str, kind: str = "otsu") -> DataFrame:
    """One row ``threshold`` by Otsu's between-class variance, for ``valley`` damped by how often a score (to 2 digits) occurs.

    The scores in [0, 1] fall into as many bins as there are scores, and cut
    ``t`` stands for the t-th score in descending order. Only filled bins are
    kept; between two of them the variance does not change. Null if no cut
    splits the scores.
    """
    table = stage(scores.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s")), "scores")
    n = table.count()
    at = F.least(F.floor(F.col("s") * n), F.lit(n - 1))
    hist = table.where("s between 0 and 1").groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("w", F.col("n") * F.col("bin"))
    all_ = F.broadcast(hist.agg(F.sum("n").alias("c"), F.sum("w").alias("cw")))
    sums = running(hist, "bin", ["n", "w"]).crossJoin(all_).withColumn("c1", F.col("run_n") - F.col("n")).withColumn("w1", F.col("run_w") - F.col("w"))
    q1 = F.col("c1") / F.col("c")
    m1, m2 = F.try_divide("w1", "c1"), F.try_divide(F.col("cw") - F.col("w1"), F.col("c") - F.col("c1"))
    # every cut in (prev, bin] has the same variance
    cuts = sums.where((F.col("c1") > 0) & (F.col("c1") < F.col("c"))).select((F.coalesce("prev", F.lit(-1)) + 1).alias("t"), "bin", (q1 * (1 - q1) * F.pow(m1 - m2, 2)).alias("v"))
    # scores that agree to two digits are neighbours: about a hundred ranges of places
    groups = table.groupBy(F.bround("s", 2).alias("r")).agg(F.count("*").alias("k"))
    down = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.select("k", F.max("k").over(Window.partitionBy()).alias("most"), F.sum("k").over(down).alias("to")).withColumn("from", F.col("to") - F.col("k"))
    damp = 1 - F.col("k") / F.col("most") if kind == "valley" else F.lit(1.0)
    met = cuts.join(F.broadcast(groups), (F.col("from") <= F.col("bin")) & (F.col("to") > F.col("t")))
    place = F.greatest(F.col("t"), F.col("from"), F.lit(1))
    best = met.where((place < F.col("to")) & (place <= F.col("bin")) & (place < n - 1)).agg(F.max_by(place, F.struct(F.round(F.col("v") * damp, 9), -place)).alias("t"))
    num = _numbered(table, "s")
    found = num.join(F.broadcast(best), (n - F.col("after") <= F.col("t")) & (F.col("t") < n - F.col("first")))
    return found.agg(F.max("s").alias("threshold"))


def threshold(scores: DataFrame, score: str, kind: str) -> float:
    """A threshold by name: elbow, otsu, valley, or 0.5 for static and unknown names."""
    if kind == "elbow":
        return elbow(scores, score).first()[0]
    if kind in ("otsu", "valley"):
        found = histogram_threshold(scores, score, kind).first()[0]
        return -1.0 if found is None else found
    return 0.5


# --- profiles -----------------------------------------------------------------------


def attribute_weights(records: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """``(attribute, weight)``: log2 of the number of distinct values, in one pass."""
    count = F.countDistinct if exact else F.approx_count_distinct
    one = records.agg(*(count(F.col(c).cast("string")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.log2(F.col(c).cast("double")).alias("weight")) for c in columns))).alias("x")).select("x.*")


def profile(records: DataFrame, columns: list[str]) -> DataFrame:
    """``(attribute, density, uniqueness, avg_chars, std_chars, avg_words)`` in one pass."""
    parts = []
    for c in columns:
        t = F.col(c).cast("string")
        there = F.when(t != "", t)
        parts.append(F.struct(F.lit(c).alias("attribute"), F.avg(there.isNotNull().cast("double")).alias("density"), F.try_divide(F.countDistinct(there), F.count(there)).alias("uniqueness"), F.avg(F.length(there)).alias("avg_chars"), F.stddev_pop(F.length(there)).alias("std_chars"), F.avg(F.size(F.split(there, r"\s+"))).alias("avg_words")))
    return records.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def column_types(records: DataFrame, columns: list[str]) -> DataFrame:
    """``(attribute, type)``: numeric, date, long_str (over six words on average) or str, in one pass."""
    from linkspark.functions.units import is_date

    parts = []
    for c in columns:
        t = F.col(c).cast("string")
        there = F.when(t != "", t)
        number, date = (F.avg(x.cast("double")) for x in (F.when(there.isNotNull(), there.try_cast("double").isNotNull()), F.when(there.isNotNull(), is_date(there))))
        kind = F.when(number == 1, "numeric").when(date > 0.5, "date").when(F.avg(F.size(F.split(there, r"\s+"))) > 6, "long_str").otherwise("str")
        parts.append(F.struct(F.lit(c).alias("attribute"), kind.alias("type")))
    return records.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def corner_cases(scored: DataFrame, score: str, label: str) -> DataFrame:
    """``(label, bucket, n, share)`` over six fixed buckets of the score."""
    bucket = F.when(F.col(score) < 0, -1).otherwise(F.least(F.floor(F.col(score) * 5), F.lit(4))).cast("int")
    counts = scored.groupBy(F.col(label).alias("label"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def drop_sparse(df: DataFrame, limit: float = 0.7) -> DataFrame:
    """Columns whose share of missing values is below ``limit``."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if (shares[c] or 0.0) < limit))


def to_numbers(df: DataFrame, columns: list[str], missing: str = "/") -> DataFrame:
    """``missing`` to null and the rest to numbers where they are."""
    return df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit(missing)).try_cast("double") for c in columns})


def ensure_columns(df: DataFrame, columns: list[str], fill: str = "/") -> DataFrame:
    """Add columns that are not there."""
    return df.withColumns({c: F.lit(fill) for c in columns if c not in df.columns})


def share_of_rows(df: DataFrame, group: str) -> DataFrame:
    """``(group, n, share)``."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def sources_of(source_pairs: int) -> int:
    """The smallest n with n (n - 1) / 2 >= the number of source pairs."""
    n = 0
    while n * (n - 1) // 2 < source_pairs:
        n += 1
    return n


def occurrence_scores(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(record, leader, inter, intra)``: inter = ln(leaders / leaders with the record), intra = tasks with it x inter.

    ``assigned`` maps ``task`` to ``leader``.
    """
    leaders = assigned.select("leader").distinct().count()
    rows = pairs.select(F.concat_ws("|", "src_a", "src_b").alias("task"), F.explode(F.array("id_a", "id_b")).alias("record")).distinct().join(assigned, "task")
    inter = rows.groupBy("record").agg(F.log(F.lit(float(leaders)) / F.countDistinct("leader")).alias("inter"))
    tasks = rows.groupBy("record", "leader").agg(F.countDistinct("task").alias("tasks"))
    return tasks.join(inter, "record").select("record", "leader", "inter", (F.col("tasks") * F.col("inter")).alias("intra"))


def gold_clusters(entities: DataFrame, key: str, iri: str) -> DataFrame:
    """``(key, members, size)``: entities with one ground-truth id; clusters are small by nature."""
    return entities.groupBy(key).agg(F.sort_array(F.collect_set(iri)).alias("members")).withColumn("size", F.size("members"))


def majority_labels(members: DataFrame, comp: str, key: str, iri: str) -> DataFrame:
    """``(iri, label)``: 1 where the entity has its component's most frequent key (the smallest of equals)."""
    counts = members.groupBy(comp, key).agg(F.count("*").alias("n"))
    best = counts.withColumn("at", F.row_number().over(Window.partitionBy(comp).orderBy(F.desc("n"), key))).where("at = 1").select(comp, F.col(key).alias("best"))
    return members.join(best, comp).select(iri, (F.col(key) == F.col("best")).cast("int").alias("label"))


def size_histogram(members: DataFrame, cluster: str) -> DataFrame:
    """``(size, clusters)``."""
    return members.groupBy(cluster).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))
