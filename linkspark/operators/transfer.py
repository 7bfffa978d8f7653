"""Moving labels between tasks: instance transfer and boosting of training data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.similarity import cosine, squared_distance
from linkspark.operators import kernels
from linkspark.operators.active import vote_share

#: Rows of either class that a classifier needs.
LEAST_OF_CLASS = 20


def _neighbours(queries: DataFrame, points: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """``(id, n, nid, label, features)``: the k nearest points of each row, ties by id."""
    q = queries.select("id", F.col("features").alias("qf"))
    p = points.select(F.col("id").alias("nid"), "features", *(["label"] if "label" in points.columns else []))
    near = q.crossJoin(p)
    if skip_self:
        near = near.where("id <> nid")
    order = Window.partitionBy("id").orderBy(squared_distance(F.col("qf"), F.col("features")), "nid")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("qf")


def _centroid(near: DataFrame, name: str) -> DataFrame:
    each = near.select("id", F.posexplode("features").alias("f", "x")).groupBy("id", "f").agg(F.avg("x").alias("m"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda s: s["m"]).alias(name))


def instance_scores(source: DataFrame, target: DataFrame, k: int = 10) -> DataFrame:
    """``(id, confidence, structure)`` of labelled source rows ``(id, features, label)``.

    Confidence is the share of the k nearest other source rows with the same
    label; structure is exp(-5 d / sqrt(dim)) of the distance d between the
    centroids of the k nearest source rows (the row among them) and the k
    nearest target rows.
    """
    others = _neighbours(source, source, k, True).withColumnRenamed("label", "other")
    confidence = others.join(source.select("id", "label"), "id").groupBy("id").agg((F.sum((F.col("other") == F.col("label")).cast("int")) / float(k)).alias("confidence"))
    mine, theirs = _centroid(_neighbours(source, source, k, False), "ms"), _centroid(_neighbours(source, target, k, False), "mt")
    d = F.sqrt(squared_distance(F.col("ms"), F.col("mt")))
    structure = mine.join(theirs, "id").select("id", F.exp(-5 * d / F.sqrt(F.size("ms"))).alias("structure"))
    return confidence.join(structure, "id")


def select_instances(source: DataFrame, target: DataFrame, k: int = 10, t_c: float = 0.9, t_l: float = 0.9) -> DataFrame:
    """Source rows whose confidence and structure reach the thresholds."""
    s = instance_scores(source, target, k)
    return source.join(s.where((F.col("confidence") >= t_c) & (F.col("structure") >= t_l)), "id")


def _forest(rows: DataFrame, budget: int, seed: int) -> list[kernels.Tree] | None:
    """A forest on at most ``budget`` rows, or none with too few of a class."""
    pdf = rows.select("features", "label").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(budget).toPandas()
    y = pdf["label"].to_numpy(float)
    if (y == 1).sum() < LEAST_OF_CLASS or (y == 0).sum() < LEAST_OF_CLASS:
        return None
    x = np.stack(pdf["features"].to_numpy()).astype(float)
    return kernels.committee(x, y, 50, seed, features=max(1, int(math.sqrt(x.shape[1]))))


def balanced(pseudo: DataFrame, t_p: float, per_positive: int = 3) -> DataFrame:
    """Confident pseudo-labels, non-matches capped at ``per_positive`` per match where they are more; the most confident stay."""
    sure = pseudo.where(F.col("confidence") >= t_p)
    n = F.broadcast(sure.agg(F.sum((F.col("label") == 1).cast("int")).alias("pos"), F.sum((F.col("label") == 0).cast("int")).alias("neg")))
    ranked = sure.crossJoin(n).withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("confidence"), "id")))
    return ranked.where((F.col("label") == 1) | (F.col("neg") <= F.col("pos")) | (F.col("at") <= per_positive * F.col("pos"))).drop("pos", "neg", "at")


def transfer(source: DataFrame, target: DataFrame, k: int = 10, t_c: float = 0.9, t_l: float = 0.9, t_p: float = 0.9, budget: int = 5000, seed: int = 0) -> DataFrame | None:
    """``(id, label, prediction)`` of target rows: instances, a forest, pseudo-labels, a forest on those. None where a class is too rare."""
    first = _forest(select_instances(source, target, k, t_c, t_l), budget, seed)
    if first is None:
        return None
    voted = vote_share(target.select("id", "features"), first)
    pseudo = voted.select("id", "features", (F.col("p") >= 0.5).cast("int").alias("label"), F.greatest("p", 1 - F.col("p")).alias("confidence"))
    second = _forest(balanced(pseudo, t_p), budget, seed + 1)
    if second is None:
        return None
    return vote_share(target.select("id", "features", "label"), second).select("id", "label", (F.col("p") >= 0.5).alias("prediction"))


# --- boosting -----------------------------------------------------------------------------------


def informative(training: DataFrame) -> DataFrame:
    """``(id, label, features, info, reach)`` of a labelled set that is at most the labelling budget.

    ``info`` averages an entropy of the cosine sums to the own and the other
    class with the share of the own class that is nearer than the nearest of
    the other; ``reach`` lies halfway from that nearest cosine to 1.
    """
    n = training.count()
    a = training.select("id", "label", "features")
    b = training.select(F.col("label").alias("l2"), F.col("features").alias("f2"))
    pairs = a.crossJoin(b).select("id", "label", "features", (F.col("label") == F.col("l2")).alias("same"), cosine(F.col("features"), F.col("f2")).alias("c"))
    sums = pairs.groupBy("id", "label", "features").agg(F.sum(F.when(F.col("same"), F.col("c"))).alias("own"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("c"))), F.lit(0.0)).alias("other"), F.max(F.when(~F.col("same"), F.col("c"))).alias("near"), F.count(F.when(F.col("same"), 1)).alias("k"))
    closer = pairs.where("same").join(sums.select("id", "near"), "id").groupBy("id").agg(F.sum((F.col("c") >= F.col("near")).cast("int")).alias("closer"))

    def h(x):
        p = x / float(max(n, 1))
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    full = sums.join(closer, "id")
    return full.select("id", "label", "features", ((F.col("closer") / F.col("k") + h(F.col("own")) + h(F.col("other"))) / 2).alias("info"), (F.col("near") + (1 - F.col("near")) / 2).alias("reach"))


def boost(training: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """``(id, features, label)``: unlabelled rows within reach of an informative training row of one class, in the training set's class ratio.

    Informative are rows at or above the 90th percentile. Rows within reach
    of both classes take the match. Rows with equal vectors count once.
    """
    info = informative(training)
    cut = info.agg(F.percentile("info", 0.9).alias("cut"))
    strong = info.crossJoin(F.broadcast(cut)).where("info >= cut").select(F.col("label").alias("l"), F.col("features").alias("f"), "reach")
    near = unlabelled.select("id", "features").crossJoin(F.broadcast(strong)).where(cosine(F.col("features"), F.col("f")) >= F.col("reach"))
    found = near.groupBy("features").agg(F.min("id").alias("id"), F.max("l").alias("label"))
    share = training.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    if not 0 < share < 1:
        return found.select("id", "features", "label").limit(0)
    rare, per = (1, math.ceil((1 - share) / share)) if share < 0.5 else (0, math.ceil(share / (1 - share)))
    at = found.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("id")))
    n = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    keep = min(n.get(rare, 0), n.get(1 - rare, 0) // per)
    return at.where(((F.col("label") == rare) & (F.col("at") <= keep)) | ((F.col("label") != rare) & (F.col("at") <= keep * per))).select("id", "features", "label")


def score_batches(batches: Iterator[pd.DataFrame], trees: list[kernels.Tree]) -> Iterator[pd.DataFrame]:
    """Votes of a forest over ``(id, features)`` batches."""
    for pdf in batches:
        x = np.stack(pdf["features"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
        yield pd.DataFrame({"id": pdf["id"], "p": kernels.vote(trees, x)})
