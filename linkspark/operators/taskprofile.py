"""Summary and profile of one matching task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators import classify, scores


def summary(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: records of both sides, pairs, matches, shares, features and their mean density. ``pairs`` has ``features, label`` (0/1)."""
    sizes = source.agg(F.count("*").alias("records_source")).crossJoin(target.agg(F.count("*").alias("records_target")))  # one row each
    m = F.sum(F.col("label").cast("long"))
    labels = pairs.agg(F.count("*").alias("n_pairs"), m.alias("matches"), (F.count("*") - m).alias("non_matches"), F.avg(F.col("label").cast("double")).alias("ratio_pos"), F.max(F.size("features")).alias("n_features"))
    density = scores.feature_stats(pairs).agg(F.avg("density").alias("avg_density"))
    return sizes.crossJoin(labels).crossJoin(density)


def best_thresholds(pairs: DataFrame) -> DataFrame:
    """``(feature, threshold, errors)``: for each feature the smallest hundredth with fewest wrong pairs; all features in one pass."""
    long = pairs.select(F.col("label").cast("long").alias("label"), F.posexplode("features").alias("feature", "x")).where("x is not null")
    cut = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor(F.round(F.col("x") * 100, 9)))).cast("int")
    per = long.groupBy("feature", cut.alias("c")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    steps = F.broadcast(pairs.sparkSession.range(101).select(F.col("id").cast("int").alias("t")))
    errors = per.crossJoin(steps).groupBy("feature", "t").agg(F.sum(F.when(F.col("c") >= F.col("t"), F.col("neg")).otherwise(F.col("pos"))).alias("errors"))
    best = errors.groupBy("feature").agg(F.min(F.struct("errors", "t")).alias("b"))
    return best.select("feature", (F.col("b.t") / 100).alias("threshold"), F.col("b.errors").alias("errors"))


def relevant_features(pairs: DataFrame, share: float = 0.95, seed: int = 1) -> tuple[list[int], list[int], float]:
    """Features by importance, the shortest prefix of them that reaches ``share`` of the best F1, and that F1."""
    data = pairs.select("features", F.col("label").cast("double").alias("label"))
    weights = classify.importances(classify.train(data, "rf", seed=seed))
    order = [i for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)) if weights[i] > 0]
    whole = classify.split_validation(data, "rf", seed=seed)["f1"]
    for k in range(1, len(order) + 1):
        part = data.withColumn("features", F.array(*(F.col("features")[i] for i in order[:k])))
        if classify.split_validation(part, "rf", seed=seed)["f1"] > share * whole:
            return order, order[:k], whole
    return order, order, whole
