"""Distribution tests between part tasks, and their verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import distribution as dist
from linkspark.operators import pairs
from linkspark.plans.staging import stage
from linkspark.queries import query, table
from linkspark.queries.similarity import _VECTOR_SQL, part_features

_HIST_SQL = (
    _VECTOR_SQL
    + """, hs AS (SELECT t1 || '|' || t2 AS task, i - 1 AS feature, f[i] AS value, count(*) AS n FROM v, (SELECT unnest(range(1, 6)) AS i) GROUP BY ALL),
t AS (SELECT DISTINCT t1 AS a, t2 AS b FROM v), tp AS (SELECT x.a || '|' || x.b AS task_a, y.a || '|' || y.b AS task_b FROM t x JOIN t y ON x.a <> y.a AND x.b <> y.b AND (x.a, x.b) < (y.a, y.b)),
m AS (SELECT task_a, task_b, feature, value, sum(c1) AS c1, sum(c2) AS c2 FROM (SELECT task_a, task_b, feature, value, n AS c1, 0 AS c2 FROM tp JOIN hs ON task = task_a UNION ALL SELECT task_a, task_b, feature, value, 0, n FROM tp JOIN hs ON task = task_b) GROUP BY ALL),
r AS (SELECT *, sum(c1) OVER w / sum(c1) OVER k AS f1, sum(c2) OVER w / sum(c2) OVER k AS f2, lead(value) OVER (PARTITION BY task_a, task_b, feature ORDER BY value) - value AS step,
      min(value) OVER k AS low, max(value) OVER k AS high, sum(c1) OVER k AS n1, sum(c2) OVER k AS n2
      FROM m WINDOW k AS (PARTITION BY task_a, task_b, feature), w AS (PARTITION BY task_a, task_b, feature ORDER BY value ROWS UNBOUNDED PRECEDING))
"""
)
_PSI_SQL = """, b AS (SELECT task_a, task_b, feature, least(floor((value - CASE WHEN low = high THEN low - 0.5 ELSE low END) / (CASE WHEN low = high THEN 1 ELSE high - low END) * 100), 99) AS bin, sum(c1 / n1) AS p1, sum(c2 / n2) AS p2 FROM r GROUP BY ALL),
p AS (SELECT task_a, task_b, feature, sum((p1 - p2) * ln((p1 + 1e-6) / (p2 + 1e-6))) AS psi FROM b GROUP BY ALL)
"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = part_features(spark, sf_dir)
    hist = stage(dist.histogram(f), "hist")
    tasks = hist.select("task").distinct().select(F.split("task", r"\|")[0].alias("src_a"), F.split("task", r"\|")[1].alias("src_b"))
    tp = pairs.task_pairs(tasks).select(F.concat_ws("|", "a1", "b1").alias("task_a"), F.concat_ws("|", "a2", "b2").alias("task_b"))
    return hist, tp


@query("STA-01_ks", _HIST_SQL + "SELECT task_a, task_b, CAST(feature AS INTEGER) AS feature, round(max(abs(f1 - f2)), 6) AS ks FROM r GROUP BY ALL")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic of every feature and task pair."""
    return dist.ks_and_wasserstein(*_inputs(spark, sf_dir)).select("task_a", "task_b", "feature", F.round("ks", 6).alias("ks"))


@query("STA-01_ks_p_value")
def ks_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p-values."""
    return dist.with_ks_p(dist.ks_and_wasserstein(*_inputs(spark, sf_dir))).select("task_a", "task_b", "feature", "ks", "p_value")


@query("STA-02_wasserstein", _HIST_SQL + "SELECT task_a, task_b, CAST(feature AS INTEGER) AS feature, round(sum(abs(f1 - f2) * step), 6) AS wasserstein FROM r GROUP BY ALL")
def wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wasserstein distance of every feature and task pair."""
    return dist.ks_and_wasserstein(*_inputs(spark, sf_dir), zero_missing=True).select("task_a", "task_b", "feature", F.round("wasserstein", 6).alias("wasserstein"))


@query("STA-04_psi", _HIST_SQL + _PSI_SQL + "SELECT task_a, task_b, CAST(feature AS INTEGER) AS feature, round(psi, 5) AS psi, round(psi / (2 * ln((1 + 1e-6) / 1e-6)), 6) AS psi_scaled FROM p")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability index, raw and scaled."""
    return dist.psi(*_inputs(spark, sf_dir)).select("task_a", "task_b", "feature", F.round("psi", 5).alias("psi"), F.round("psi_scaled", 6).alias("psi_scaled"))


@query("STA-05_one_sided", "SELECT 'a' AS task_a, 'b' AS task_b, CAST(1 AS INTEGER) AS feature, CAST(-2 AS DOUBLE) AS stat")
def one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature that only one of two tasks has."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.lit("a").alias("task"), F.lit(0).alias("feature"), F.col("p_size").cast("double").alias("value"))
    b = a.withColumn("task", F.lit("b"))
    both = a.unionByName(b).unionByName(a.withColumn("feature", F.lit(1))).groupBy("task", "feature", "value").agg(F.count("*").alias("n"))
    return dist.one_sided_features(both, spark.createDataFrame([("a", "b")], "task_a string, task_b string"))


@query("STA-10_verdict", _HIST_SQL + ", s AS (SELECT task_a, task_b, feature, sum(abs(f1 - f2) * step) AS w FROM r GROUP BY ALL) SELECT task_a, task_b, CASE WHEN max(w) <= 0.1 THEN 1.0 ELSE round(avg(CAST(w < 0.1 AS INT)), 3) END AS similarity FROM s GROUP BY ALL")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of task pairs by the Wasserstein distance."""
    t = dist.long_form(dist.ks_and_wasserstein(*_inputs(spark, sf_dir)), "wasserstein", "wasserstein")
    return dist.similar(dist.similarity(t)).select("task_a", "task_b", "similarity")


@query("STA-11_weighted_mean", _HIST_SQL + ", s AS (SELECT task_a, task_b, feature, 1 - sum(abs(f1 - f2) * step) AS v FROM r GROUP BY ALL), wt AS (SELECT i - 1 AS feature, CASE WHEN stddev_pop(f[i]) = 0 THEN 0.05 ELSE stddev_pop(f[i]) END AS w FROM v, (SELECT unnest(range(1, 6)) AS i) GROUP BY i) SELECT task_a, task_b, round(sum(w * CASE WHEN s.v > 0.05 THEN s.v ELSE 0 END) / sum(w), 5) AS avg_similarity FROM s JOIN wt USING (feature) GROUP BY ALL")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of task pairs weighted by the features' deviation."""
    t = dist.long_form(dist.ks_and_wasserstein(*_inputs(spark, sf_dir)), "wasserstein", "wasserstein")
    return dist.similarity(t, dist.feature_weights(part_features(spark, sf_dir))).select("task_a", "task_b", F.round("avg_similarity", 5).alias("avg_similarity"))


@query("STA-12_feature_weights", _VECTOR_SQL + "SELECT CAST(i - 1 AS INTEGER) AS feature, round(CASE WHEN stddev_pop(f[i]) = 0 THEN 0.05 ELSE stddev_pop(f[i]) END, 6) AS weight FROM v, (SELECT unnest(range(1, 6)) AS i) GROUP BY i")
def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of each feature over all pairs."""
    return dist.feature_weights(part_features(spark, sf_dir)).select("feature", F.round("weight", 6).alias("weight"))


@query("STA-07_mmd", """WITH x AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0), y AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 1),
    s AS (SELECT (SELECT sum(exp(-0.5 * list_distance(a.e, b.e) ** 2)) FROM x a, x b) AS xx, (SELECT sum(exp(-0.5 * list_distance(a.e, b.e) ** 2)) FROM y a, y b) AS yy, (SELECT sum(exp(-0.5 * list_distance(a.e, b.e) ** 2)) FROM x a, y b) AS xy, (SELECT count(*) FROM x) AS m, (SELECT count(*) FROM y) AS n)
    SELECT round(xx / (m * (m - 1)) - 2 * xy / (m * n) + yy / (n * (n - 1)), 6) AS mmd2 FROM s""")
def mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum mean discrepancy of the vectors of labels 0 and 1."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector"))
    return dist.mmd(e.where("label = 0"), e.where("label = 1"), 0.5).select(F.round("mmd2", 6).alias("mmd2"))


@query("STA-08_mmd_permutation")
def mmd_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation test of all vectors of labels 0 and 1."""
    e = table(spark, sf_dir, "embeddings").where("label in (0, 1)")
    return dist.mmd_permutation_blocks(e.select(F.col("label").alias("side"), F.col("embedding").alias("vector")), 0.5)
