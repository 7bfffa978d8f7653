"""Distribution tests between linkage tasks, all features and all task pairs in one query.

Input is the pairs table ``(src_a, src_b, id_a, id_b, features)``; a task is
``src_a|src_b``. Values are counted per task and feature first, so that what
is joined for each task pair is its distinct values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.similarity import squared_distance

PSI_BINS, PSI_EPSILON = 100, 1e-6
#: PSI of two wholly disjoint bins, which scales it to [0, 1].
PSI_SCALE = 2 * math.log((1 + PSI_EPSILON) / PSI_EPSILON)
#: Largest product of sample sizes for which the exact p-value is computed.
EXACT_KS = 10_000


def task_name() -> Column:
    """``src_a|src_b``."""
    return F.concat_ws("|", "src_a", "src_b")


def histogram(pairs: DataFrame) -> DataFrame:
    """``(task, feature, value, n)``: counts of distinct values."""
    long = pairs.select(task_name().alias("task"), F.posexplode("features").alias("feature", "value"))
    return long.where("value is not null and not isnan(value)").groupBy("task", "feature", "value").agg(F.count("*").alias("n"))


def _two_sided(hist: DataFrame, task_pairs: DataFrame) -> DataFrame:
    """``(task_a, task_b, feature, value, c1, c2)`` with the counts of either task."""
    sides = []
    for mine, c1, c2 in (("task_a", F.col("n"), F.lit(0)), ("task_b", F.lit(0), F.col("n"))):
        sides.append(task_pairs.join(hist, task_pairs[mine] == hist["task"]).select("task_a", "task_b", "feature", "value", c1.cast("long").alias("c1"), c2.cast("long").alias("c2")))
    return sides[0].unionByName(sides[1]).groupBy("task_a", "task_b", "feature", "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))


def ks_and_wasserstein(hist: DataFrame, task_pairs: DataFrame, zero_missing: bool = False) -> DataFrame:
    """``(task_a, task_b, feature, n1, n2, ks, wasserstein)``.

    Both come from the same running sums over the merged distinct values.
    ``zero_missing`` counts the sentinel -1 as 0, as the Wasserstein test does.
    """
    if zero_missing:
        hist = hist.groupBy("task", "feature", F.when(F.col("value") == -1, 0.0).otherwise(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    key = Window.partitionBy("task_a", "task_b", "feature")
    so_far = key.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = _two_sided(hist, task_pairs).select("*", F.sum("c1").over(so_far).alias("r1"), F.sum("c2").over(so_far).alias("r2"), F.sum("c1").over(key).alias("n1"), F.sum("c2").over(key).alias("n2"), F.lead("value").over(key.orderBy("value")).alias("next"))
    gap = F.abs(F.col("r1") / F.col("n1") - F.col("r2") / F.col("n2"))
    out = run.where("n1 > 0 and n2 > 0").groupBy("task_a", "task_b", "feature", "n1", "n2")
    return out.agg(F.max(gap).alias("ks"), F.coalesce(F.sum(gap * (F.col("next") - F.col("value"))), F.lit(0.0)).alias("wasserstein"))


def _exact_ks(d: float, m: int, n: int) -> float:
    """P(D >= d) by counting lattice paths that stay inside, as probabilities column by column."""
    m, n = max(m, n), min(m, n)
    g = math.gcd(m, n)
    h = round(d * (m // g) * n)  # d in units of 1 / lcm
    if h == 0:
        return 1.0
    limit = h / ((m // g) * n) * m * n
    row = np.zeros(n + 1)
    inside = np.abs(np.arange(n + 1) * m) < limit - 1e-9
    row[:] = np.cumprod(inside)
    ways = row.copy()
    scale = 0.0
    for i in range(1, m + 1):
        ok = np.abs(i * n - np.arange(n + 1) * m) < limit - 1e-9
        new = np.zeros(n + 1)
        run = 0.0
        for j in range(n + 1):
            run = (ways[j] + run) if ok[j] else 0.0
            new[j] = run
        top = new.max()
        if top == 0:
            return 1.0
        ways, scale = new / top, scale + math.log(top)
    total = math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1)
    return float(min(1.0, max(0.0, 1 - math.exp(math.log(max(ways[n], 1e-300)) + scale - total))))


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Two-sided p-value: exact for small samples, else the limiting distribution's series."""
    if n1 * n2 <= EXACT_KS:
        return _exact_ks(d, n1, n2)
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101)))))


def with_ks_p(tests: DataFrame) -> DataFrame:
    """Add ``p_value``; an Arrow function over one row per task pair and feature."""

    @F.pandas_udf("double")
    def p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([ks_p_value(x, int(a), int(b)) for x, a, b in zip(d, n1, n2, strict=True)])

    return tests.withColumn("p_value", p("ks", "n1", "n2"))


def psi(hist: DataFrame, task_pairs: DataFrame) -> DataFrame:
    """``(task_a, task_b, feature, psi, psi_scaled)`` over 100 equal bins of the pooled range; a constant is binned in its half-unit surroundings."""
    both = _two_sided(hist, task_pairs)
    key = Window.partitionBy("task_a", "task_b", "feature")
    low, high = F.min("value").over(key), F.max("value").over(key)
    ranged = both.select("*", F.when(low == high, low - 0.5).otherwise(low).alias("low"), F.when(low == high, high + 0.5).otherwise(high).alias("high"), F.sum("c1").over(key).alias("n1"), F.sum("c2").over(key).alias("n2"))
    at = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * PSI_BINS), F.lit(PSI_BINS - 1))
    bins = ranged.where("n1 > 0 and n2 > 0").groupBy("task_a", "task_b", "feature", at.alias("bin")).agg(F.sum(F.col("c1") / F.col("n1")).alias("p1"), F.sum(F.col("c2") / F.col("n2")).alias("p2"))
    term = (F.col("p1") - F.col("p2")) * F.log((F.col("p1") + PSI_EPSILON) / (F.col("p2") + PSI_EPSILON))
    return bins.groupBy("task_a", "task_b", "feature").agg(F.sum(term).alias("psi")).withColumn("psi_scaled", F.col("psi") / PSI_SCALE)


def long_form(tests: DataFrame, stat: str, test: str) -> DataFrame:
    """``(task_a, task_b, feature, stat, p_value, test)`` of one test's result."""
    p = F.col("p_value") if "p_value" in tests.columns else F.lit(None).cast("double")
    return tests.select("task_a", "task_b", "feature", F.col(stat).alias("stat"), p.alias("p_value"), F.lit(test).alias("test"))


def similarity(stats: DataFrame, weights: DataFrame | None = None, alpha: float = 0.05, faithful: bool = False) -> DataFrame:
    """``(task_a, task_b, similarity, avg_similarity)`` of long-form tests.

    For ``ks`` the verdict is 1 if no p-value is below ``alpha``, else the
    share above it; for others 1 if no statistic exceeds 0.1, else the share
    below, both to three digits. ``avg_similarity`` is the mean of 1 - stat
    weighted by feature, values up to 0.05 counting as 0; -1 without weight.
    ``faithful`` leaves out feature 0 where any value is exactly 0 and feature
    1 where any is exactly 1, as the index filter of the original does.
    """
    ks = F.col("test") == "ks"
    passed = F.when(ks, F.col("p_value") >= alpha).otherwise(F.col("stat") <= 0.1)
    above = F.when(ks, F.col("p_value") > alpha).otherwise(F.col("stat") < 0.1)
    verdict = F.when(F.min(passed.cast("int")) == 1, 1.0).otherwise(F.round(F.avg(above.cast("double")), 3))
    v = 1 - F.col("stat")
    w = F.col("weight")
    if weights is None:
        stats = stats.withColumn("weight", F.lit(1.0))
    else:
        stats = stats.join(weights, "feature")
    if faithful:
        key = Window.partitionBy("task_a", "task_b", "test")
        for f, exact in ((0, 0.0), (1, 1.0)):
            hit = F.max((v == exact).cast("int")).over(key) == 1
            w = F.when((F.col("feature") == f) & hit, 0.0).otherwise(w)
    marked = stats.select("*", w.alias("w"), F.when(v > 0.05, v).otherwise(0.0).alias("v"), passed.alias("passed"), above.alias("above"))
    mean = F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("v")) / F.sum("w")).otherwise(-1.0)
    return marked.groupBy("task_a", "task_b").agg(verdict.alias("similarity"), mean.alias("avg_similarity"))


def similar(results: DataFrame) -> DataFrame:
    """Results whose verdict is not negative."""
    return results.where("similarity >= 0")


def feature_weights(pairs: DataFrame) -> DataFrame:
    """``(feature, weight)``: population deviation over all vectors, 0 becoming 0.05."""
    sd = pairs.select(F.posexplode("features").alias("feature", "value")).groupBy("feature").agg(F.stddev_pop("value").alias("sd"))
    return sd.select("feature", F.when(F.col("sd") == 0, 0.05).otherwise(F.col("sd")).alias("weight"))


def one_sided_features(hist: DataFrame, task_pairs: DataFrame) -> DataFrame:
    """``(task_a, task_b, feature, stat)`` with -2 for features that only one task has values of."""
    has = hist.select("task", "feature").distinct()
    a = task_pairs.join(has, task_pairs.task_a == has.task).select("task_a", "task_b", "feature")
    b = task_pairs.join(has, task_pairs.task_b == has.task).select("task_a", "task_b", "feature")
    return a.subtract(b).unionByName(b.subtract(a)).withColumn("stat", F.lit(-2.0))


def missing_convention(n1: Column, n2: Column, stat: Column, ks: bool) -> Column:
    """Fixed results where one or both sides have no values."""
    both, one = (0.06, 0.04) if ks else (0.9, 0.2)
    return F.when((n1 == 0) & (n2 == 0), both).when((n1 == 0) | (n2 == 0), one).otherwise(stat)


def mmd(x: DataFrame, y: DataFrame, gamma: float) -> DataFrame:
    """One row ``mmd2``, ``mmd``: sums of the Gaussian kernel with the diagonal kept, over m (m - 1), n (n - 1) and m n. Columns ``vector``."""

    def total(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        pairs = a.select(F.col("vector").alias("p")).crossJoin(b.select(F.col("vector").alias("q")))
        return pairs.agg(F.sum(F.exp(-gamma * squared_distance(F.col("p"), F.col("q")))).alias(name))

    m, n = F.lit(float(x.count())), F.lit(float(y.count()))
    all_ = total(x, x, "xx").crossJoin(total(y, y, "yy")).crossJoin(total(x, y, "xy"))  # one row each
    value = F.col("xx") / (m * (m - 1)) - 2 * F.col("xy") / (m * n) + F.col("yy") / (n * (n - 1))
    return all_.select(value.alias("mmd2"), F.sqrt(F.greatest(value, F.lit(0.0))).alias("mmd"))


def _mmd2(k: np.ndarray, m: int) -> float:
    n = len(k) - m
    return k[:m, :m].sum() / (m * (m - 1)) - 2 * k[:m, m:].sum() / (m * n) + k[m:, m:].sum() / (n * (n - 1))


def mmd_permutation(samples: DataFrame, gamma: float, permutations: int = 100, seed: int = 0) -> DataFrame:
    """``(pair, mmd, p_value)`` per group of ``(pair, side, vector)`` rows, which must be bounded samples: p = (count + 1) / (permutations + 1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable")
        v, m = np.stack(pdf["vector"].to_numpy()).astype(float), int((pdf["side"] == 0).sum())
        sq = (v * v).sum(1)
        k = np.exp(-gamma * np.maximum(sq[:, None] + sq - 2 * v @ v.T, 0))
        seen, rnd = _mmd2(k, m), np.random.default_rng(seed)
        more = 0
        for _ in range(permutations):
            at = rnd.permutation(len(v))
            more += _mmd2(k[np.ix_(at, at)], m) >= seen
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "mmd": [math.sqrt(max(seen, 0))], "p_value": [(more + 1) / (permutations + 1)]})

    return samples.groupBy("pair").applyInPandas(run, "pair string, mmd double, p_value double")


def _permuted(n: int, permutations: int, seed: int, rows: np.ndarray) -> np.ndarray:
    """Places of ``rows`` under each of several permutations of ``range(n)``: a Feistel network whose walk ends inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), np.zeros((len(rows), permutations), np.int64)
    for p in range(permutations):
        keys = np.random.default_rng([seed, p]).integers(1, 1 << 62, 6).astype(np.uint64)
        x, open_ = rows.astype(np.uint64), np.ones(len(rows), bool)
        while open_.any():
            left, right = x[open_] >> np.uint64(half), x[open_] & mask
            for k in keys:
                mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7)) & mask
            x[open_] = left << np.uint64(half) | right
            open_ = x >= n
        out[:, p] = x
    return out


def mmd_permutation_blocks(rows: DataFrame, gamma: float, permutations: int = 100, seed: int = 0, block: int = 512) -> DataFrame:
    """``(mmd, p_value)`` of the permutation test over all of ``(side, vector)``; p = (count + 1) / (permutations + 1).

    Rows are numbered side 0 first. Blocks of them meet block against block,
    once for each unordered pair, and add up the kernel for the true sides
    and for every permutation at a time; tasks hold two blocks. The work is
    quadratic, as the test is, and only sums are shuffled. Null vectors are
    left out; with fewer than two rows on a side both results are null.
    """
    from linkspark.plans.staging import stage

    rows = stage(rows.where("vector is not null").select(F.col("side").cast("int").alias("side"), F.col("vector").cast("array<double>").alias("vector")).repartition(64, "side", "vector").sortWithinPartitions("side", "vector").withColumn("at", F.monotonically_increasing_id()), "mmd-rows")
    part = F.shiftright("at", 33)
    sizes = {(r["side"], r["part"]): (r["n"], r["low"]) for r in rows.groupBy("side", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()}  # two rows per partition
    start, low, at = {}, {}, 0
    for key in sorted(sizes):
        start[key], low[key] = at, sizes[key][1]
        at += sizes[key][0]
    n, m = at, sum(v[0] for k, v in sizes.items() if k[0] == 0)
    session = rows.sparkSession
    if m < 2 or n - m < 2:
        return session.createDataFrame([(None, None)], "mmd double, p_value double")
    begin = session.createDataFrame([(*k, start[k] - low[k]) for k in sizes], "side int, part long, shift long")
    numbered = rows.withColumn("part", part).join(F.broadcast(begin), ["side", "part"]).select((F.col("at") + F.col("shift")).alias("rn"), "vector")
    blocks = -(-n // block)
    b = F.floor(F.col("rn") / block).cast("int")
    left = numbered.select("rn", "vector", b.alias("i"), F.explode(F.sequence(b, F.lit(blocks - 1))).alias("j"), F.lit(0).alias("end"))
    right = numbered.select("rn", "vector", F.explode(F.sequence(F.lit(0), b)).alias("i"), b.alias("j"), F.lit(1).alias("end"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        a, c = (pdf[pdf["end"] == e].sort_values("rn") for e in (0, 1))
        x, y = (np.stack(d["vector"].to_numpy()).astype(float) for d in (a, c))
        k = np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        first = [np.concatenate([(r := d["rn"].to_numpy())[:, None], _permuted(n, permutations, seed, r)], 1) < m for d in (a, c)]
        u, v = (f.astype(float) for f in first)
        ku, ko = k @ v, k @ (1 - v)
        xx, yy, xy = (u * ku).sum(0), ((1 - u) * ko).sum(0), (u * ko).sum(0) + (0 if same else ((1 - u) * ku).sum(0))
        return pd.DataFrame({"p": np.arange(permutations + 1), "xx": xx * (1 if same else 2), "yy": yy * (1 if same else 2), "xy": xy})

    sums = left.unionByName(right).groupBy("i", "j").applyInPandas(add, "p int, xx double, yy double, xy double").groupBy("p").agg(*(F.sum(c).alias(c) for c in ("xx", "yy", "xy")))
    value = F.col("xx") / (m * (m - 1)) - 2 * F.col("xy") / (m * (n - m)) + F.col("yy") / ((n - m) * (n - m - 1))
    got = sums.select("p", value.alias("v"))
    seen = F.max(F.when(F.col("p") == 0, F.col("v")))
    # a value per permutation
    each = got.agg(seen.alias("seen"), F.collect_list(F.when(F.col("p") > 0, F.col("v"))).alias("others"))
    more = F.size(F.filter("others", lambda x: x >= F.col("seen")))
    return each.select(F.sqrt(F.greatest("seen", F.lit(0.0))).alias("mmd"), ((more + 1) / (permutations + 1)).alias("p_value"))


def classifier_test(pairs: DataFrame, task_a: str, task_b: str, folds: int = 5, seed: int = 0) -> float:
    """Cross-validated accuracy of telling two tasks' vectors apart with boosted trees; above 0.8 they differ."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    task = task_name()
    data = pairs.where(task.isin(task_a, task_b)).select(array_to_vector("features").alias("features"), (task == task_a).cast("double").alias("label"))
    cv = CrossValidator(estimator=GBTClassifier(maxIter=10, seed=seed), estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed)
    return float(cv.fit(data).avgMetrics[0])
