"""Match rules and trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators import kernels


def _total(features: Column | str) -> Column:
    return F.aggregate(features, F.lit(0.0), lambda s, x: s + x)


def exact_rule(features: Column | str = "features") -> Column:
    """All similarities add up to their number."""
    return _total(features) == F.size(features)


def mean_rule(threshold: float, features: Column | str = "features") -> tuple[Column, Column]:
    """Match if the mean reaches the threshold; the confidence is the mean."""
    mean = F.try_divide(_total(features), F.size(features))
    return mean >= threshold, mean


def min_rule(threshold: float, features: Column | str = "features") -> tuple[Column, Column]:
    """Match if every feature reaches the threshold; the confidence is the smallest."""
    return F.array_min(features) >= threshold, F.array_min(features)


def weighted_rule(weights: list[float], threshold: float, features: Column | str = "features") -> tuple[Column, Column]:
    """Match if the weighted mean reaches the threshold."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    value = _total(F.zip_with(features, w, lambda x, y: x * y)) / F.lit(float(sum(weights)))
    return value >= threshold, value


#: Match rules by name, each of a threshold and a feature array.
RULES = {"mean": lambda t, f: mean_rule(t, f)[0], "min": lambda t, f: min_rule(t, f)[0], "exact": lambda _, f: exact_rule(f)}


def rule(name: str, threshold: float, features: Column | str = "features") -> Column:
    """A match rule by its name."""
    return RULES[name](threshold, features)


CLASSIFIERS = ("rf", "dt", "gboost", "svm", "logr", "linr")


def classifier(name: str, seed: int = 35):
    """A Spark ML estimator by its short name; the margin classifier is linear."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    return {
        "rf": lambda: C.RandomForestClassifier(seed=seed, numTrees=50), "dt": lambda: C.DecisionTreeClassifier(seed=seed), "gboost": lambda: C.GBTClassifier(seed=seed, maxIter=20),
        "svm": lambda: C.LinearSVC(), "logr": lambda: C.LogisticRegression(), "linr": lambda: R.LinearRegression(),
    }[name]()


def train(training: DataFrame, name: str = "rf", tune: int = 0, folds: int = 3, seed: int = 35, calibrate: bool = False):
    """Fit on ``(features array, label double)``.

    ``tune`` draws that many settings of the forest's grid and keeps the best
    F1 of ``folds``-fold validation. ``calibrate`` adds a logistic step on the
    raw score. With under two positives the plain model is fitted.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = training.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")).cache()
    model = classifier(name, seed)
    few = data.where("label = 1").limit(2).count() < 2
    if tune and name in ("rf", "dt") and not few:
        grid = ParamGridBuilder().addGrid(model.maxDepth, [3, 5, 8, 12]).addGrid(model.minInstancesPerNode, [1, 2, 4]).addGrid(model.impurity, ["gini", "entropy"])
        if name == "rf":
            grid = grid.addGrid(model.numTrees, [20, 50, 100])
        import random

        settings = grid.build()
        settings = random.Random(seed).sample(settings, min(tune, len(settings)))
        found = CrossValidator(estimator=model, estimatorParamMaps=settings, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=seed, parallelism=4).fit(data).bestModel
    else:
        found = model.fit(data)
    if calibrate and not few and name not in ("linr",):
        from pyspark.ml import Pipeline, PipelineModel
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        raw = found.transform(data).select("rawPrediction", "label")
        steps = Pipeline(stages=[VectorAssembler(inputCols=["rawPrediction"], outputCol="platt"), LogisticRegression(featuresCol="platt", probabilityCol="calibrated", rawPredictionCol="calibrated_raw", predictionCol="calibrated_prediction")]).fit(raw)
        found = PipelineModel(stages=[found, *steps.stages])
    data.unpersist()
    return found


def _second(probability: Column) -> Column:
    """Probability of a match; 0 if the training set had none."""
    return F.coalesce(F.get(probability, F.lit(1)), F.lit(0.0))


def apply(pairs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Add ``prediction`` (boolean) and ``confidence`` to pairs."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(pairs.withColumn("vec__", array_to_vector("features")).withColumnRenamed("features", "features__").withColumnRenamed("vec__", "features"))
    p = _second(vector_to_array("calibrated")) if "calibrated" in out.columns else _second(vector_to_array("probability")) if "probability" in out.columns else F.col("prediction")
    return out.select(*(F.col("features__").alias("features") if c == "features" else F.col(c) for c in pairs.columns), (p >= threshold).alias("prediction_"), p.alias("confidence")).withColumnRenamed("prediction_", "prediction")


def importances(model) -> list[float]:
    """Feature importances of a tree model, coefficients of a linear one."""
    return [float(x) for x in (model.featureImportances.toArray() if hasattr(model, "featureImportances") else model.coefficients.toArray())]


def rules_text(model) -> str:
    """A tree model as text."""
    return model.toDebugString


def split_validation(data: DataFrame, name: str = "rf", share: float = 0.7, seed: int = 35) -> dict[str, float]:
    """Precision, recall and F1 on a seeded held-out part."""
    fit_, test = data.randomSplit([share, 1 - share], seed)
    p = apply(test, train(fit_, name, seed=seed))
    row = p.agg(F.sum((F.col("prediction") & (F.col("label") == 1)).cast("int")).alias("tp"), F.sum((F.col("prediction") & (F.col("label") == 0)).cast("int")).alias("fp"), F.sum((~F.col("prediction") & (F.col("label") == 1)).cast("int")).alias("fn")).first()
    tp, fp, fn = (row[k] or 0 for k in ("tp", "fp", "fn"))
    return {"precision": tp / (tp + fp) if tp + fp else 0.0, "recall": tp / (tp + fn) if tp + fn else 0.0, "f1": 2 * tp / (2 * tp + fp + fn) if tp else 0.0}


def nested_validation(data: DataFrame, name: str = "rf", outer: int = 3, tune: int = 4, seed: int = 35) -> list[dict[str, float]]:
    """Scores of each outer fold after tuning inside the others."""
    folds = data.withColumn("fold__", F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(outer)))
    out = []
    for k in range(outer):
        p = apply(folds.where(F.col("fold__") == k).drop("fold__"), train(folds.where(F.col("fold__") != k).drop("fold__"), name, tune, seed=seed))
        r = p.agg(*(F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(n) for n, c in (("tp", F.col("prediction") & (F.col("label") == 1)), ("fp", F.col("prediction") & (F.col("label") == 0)), ("fn", ~F.col("prediction") & (F.col("label") == 1))))).first()
        out.append({"fold": k, "f1": 2 * r["tp"] / (2 * r["tp"] + r["fp"] + r["fn"]) if r["tp"] else 0.0})
    return out


def transfer_matrix(pairs: DataFrame, tasks: list[str], budget: int = 2000, k: int = 10, seed: int = 1) -> DataFrame:
    """``(train_task, test_task, f1)``: a forest on each task's sample of at most ``budget`` rows, applied to every task.

    All forests score all rows in one narrow pass; only counts are shuffled.
    ``pairs`` has ``task, features, label``.
    """
    import numpy as np
    import pandas as pd

    forests = {}
    for t in tasks:
        rows = pairs.where(F.col("task") == t).orderBy(F.xxhash64("features", F.lit(seed)), "features").limit(budget).select("features", "label").collect()
        x, y = np.array([r["features"] for r in rows], float), np.array([r["label"] for r in rows], float)
        forests[t] = kernels.committee(x, y, k, seed) if len(y) and y.min() != y.max() else []
    shared = pairs.sparkSession.sparkContext.broadcast(forests)  # a few small trees per task

    def score(batches):
        for pdf in batches:
            x = np.stack(pdf["features"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
            for t, trees in shared.value.items():
                yield pd.DataFrame({"train_task": t, "test_task": pdf["task"], "label": pdf["label"].astype(int), "hit": (kernels.vote(trees, x) >= 0.5).astype(int)})

    rows = pairs.select("task", "features", "label").mapInPandas(score, "train_task string, test_task string, label int, hit int")
    c = rows.groupBy("train_task", "test_task").agg(F.sum(F.col("label") * F.col("hit")).alias("tp"), F.sum((1 - F.col("label")) * F.col("hit")).alias("fp"), F.sum(F.col("label") * (1 - F.col("hit"))).alias("fn"))
    return c.select("train_task", "test_task", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))
