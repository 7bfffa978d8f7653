"""Model reuse: tests, task graph, communities, one model per community, and the search for arriving tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.operators import active, distribution, evaluation, graph, kernels, scores
from linkspark.plans import budget
from linkspark.plans.staging import new_folder, stage


@dataclass(frozen=True)
class ReuseConfig:
    """Parameters of a run."""

    test: str = "ks"
    alpha: float = 0.05
    ratio: float = 0.8
    exact_edges: bool = False
    detector: str = "leiden"
    relevance: str = "betweenness"
    total_budget: int = 2000
    min_budget: int = 50
    new_task_budget: int = 200
    batch: int = 5
    committee: int = 100
    split_ratio: float = 0.5
    method: str = "bootstrap"
    seed: int = 0


@dataclass
class Registry:
    """One small forest and its training vectors per cluster leader, and the members of each cluster."""

    models: dict[str, list[kernels.Tree]] = field(default_factory=dict)
    training: dict[str, np.ndarray] = field(default_factory=dict)
    members: dict[str, list[str]] = field(default_factory=dict)


def run_test(hist: DataFrame, task_pairs: DataFrame, test: str) -> DataFrame:
    """Long-form results of one test by name: ks, wasserstein or psi."""
    if test == "ks":
        return distribution.long_form(distribution.with_ks_p(distribution.ks_and_wasserstein(hist, task_pairs)), "ks", "ks")
    if test == "wasserstein":
        return distribution.long_form(distribution.ks_and_wasserstein(hist, task_pairs, zero_missing=True), "wasserstein", "wasserstein")
    if test == "psi":
        return distribution.long_form(distribution.psi(hist, task_pairs), "psi_scaled", "psi")
    raise ValueError(f"unknown test {test}")


def task_similarities(pairs: DataFrame, tasks: DataFrame, cfg: ReuseConfig, weights: DataFrame | None = None) -> DataFrame:
    """``(task_a, task_b, similarity, avg_similarity)`` of all comparable task pairs in one query."""
    from linkspark.operators.pairs import task_pairs

    tp = task_pairs(tasks.select("src_a", "src_b")).select(F.concat_ws("|", "a1", "b1").alias("task_a"), F.concat_ws("|", "a2", "b2").alias("task_b"))
    inside = pairs.join(F.broadcast(tasks.select("src_a", "src_b").distinct()), ["src_a", "src_b"], "left_semi")  # as many rows as source pairs
    return distribution.similarity(run_test(distribution.histogram(inside), tp, cfg.test), weights, cfg.alpha)


def _pool(pairs: DataFrame, gold: DataFrame, members: list[str], inter: DataFrame | None) -> DataFrame:
    """``(pair_id, features, label, inter)`` of some tasks; labels are looked up when asked for."""
    rows = pairs.where(distribution.task_name().isin(members)).select(F.concat_ws("\x1f", "id_a", "id_b").alias("pair_id"), "features", F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"), "id_a", "id_b")
    rows = rows.join(gold.select("lo", "hi").distinct().withColumn("g", F.lit(1.0)), ["lo", "hi"], "left")
    if inter is not None:
        score = inter.groupBy("record").agg(F.max("inter").alias("s"))
        for side in ("id_a", "id_b"):
            rows = rows.join(score.select(F.col("record").alias(side), F.col("s").alias(f"s_{side}")), side, "left")
        rows = rows.withColumn("inter", (F.coalesce("s_id_a", F.lit(0.0)) + F.coalesce("s_id_b", F.lit(0.0))) / 2)
    else:
        rows = rows.withColumn("inter", F.lit(1.0))
    return rows.select("pair_id", "features", F.coalesce("g", F.lit(0.0)).alias("label"), "inter")


def train_cluster(pairs: DataFrame, gold: DataFrame, leader: str, members: list[str], labels: int, cfg: ReuseConfig, registry: Registry, inter: DataFrame | None = None) -> None:
    """Active learning inside one cluster; the model and its training vectors go to the registry."""
    pool = _pool(pairs, gold, members, inter)
    got = active.bootstrap(pool, labels, cfg.batch, cfg.committee, cfg.seed)
    width = max(1, int(np.sqrt(got.x.shape[1]))) if got.x.size else 1
    registry.models[leader] = kernels.committee(got.x, got.y, 50, cfg.seed, features=width) if len(got.y) else []
    registry.training[leader] = got.x
    registry.members[leader] = list(members)


def generate(pairs: DataFrame, gold: DataFrame, split: DataFrame, cfg: ReuseConfig) -> Registry:
    """Models of the solved tasks: graph, communities, representatives, budgets, active learning."""
    solved = split.where("solved")
    weights = distribution.feature_weights(pairs)
    sims = stage(task_similarities(pairs, solved, cfg, weights), "reuse-sims")
    nodes, edges = graph.task_graph(solved, sims, cfg.ratio, cfg.exact_edges)
    nodes, edges = stage(nodes, "reuse-nodes"), stage(edges, "reuse-edges")
    member = stage(graph.communities(nodes, edges, cfg.detector, cfg.seed), "reuse-communities")
    central = None if cfg.relevance == "size" else graph.centrality(edges, member, cfg.relevance)
    ranked = stage(graph.representatives(member, nodes, solved.select("task", "n", "intra"), central), "reuse-ranked")
    allocated = stage(budget.allocate(ranked, solved, cfg.min_budget, cfg.total_budget), "reuse-budgets")
    if allocated.where("not fits").isEmpty():
        ranking, budgets = ranked.select("leader", "task"), allocated.select("leader", "budget")
    else:
        ranking, budgets = budget.merge_singletons(allocated, sims, ranked, solved, cfg.min_budget)
    registry = Registry()
    groups: dict[str, list[str]] = {}
    for r in ranking.select("leader", "task").collect():  # one row per task
        groups.setdefault(r["leader"], []).append(r["task"])
    inter = stage(scores.occurrence_scores(pairs, ranking.select("leader", "task")), "reuse-occurrence") if len(groups) > 1 else None
    labels = {r["leader"]: r["budget"] for r in budgets.collect()}
    for leader in sorted(groups):
        train_cluster(pairs, gold, leader, sorted(groups[leader]), labels.get(leader, cfg.min_budget), cfg, registry, inter)
    return registry


def of_task(pairs: DataFrame, task: str) -> DataFrame:
    """The pairs of one task; of a table partitioned by its sources only their folder is read."""
    found = pairs.where(distribution.task_name() == task)
    if task.count("|") == 1:
        a, b = task.split("|")
        found = found.where((F.col("src_a") == a) & (F.col("src_b") == b))
    return found


def best_models(hist: DataFrame, tasks: list[str], registry: Registry, cfg: ReuseConfig, weights: DataFrame | None = None) -> dict[str, str]:
    """For each task with a result the leader whose training vectors are distributed most like it, by mean weighted similarity.

    ``hist`` is ``distribution.histogram`` of the tasks' pairs. All tasks meet
    all leaders in one query; what comes back is a row per task.
    """
    spark = hist.sparkSession
    rows = [(leader, i, float(v)) for leader, x in registry.training.items() for row in x for i, v in enumerate(row)]
    if not rows or not tasks:
        return {}
    # at most the labelling budget
    known = spark.createDataFrame(rows, "task string, feature int, value double").groupBy("task", "feature", "value").agg(F.count("*").alias("n"))
    mine = hist.join(F.broadcast(spark.createDataFrame([(t,) for t in tasks], "task string")), "task", "left_semi").withColumn("task", F.concat(F.lit("\x1f"), "task"))
    tp = spark.createDataFrame([(f"\x1f{t}", leader) for t in tasks for leader in registry.training], "task_a string, task_b string")
    found = distribution.similarity(run_test(mine.unionByName(known), tp, cfg.test), weights, cfg.alpha).where("similarity >= 0")
    best = found.groupBy("task_a").agg(F.min(F.struct((-F.col("avg_similarity")).alias("d"), "task_b"))["task_b"].alias("leader"))
    return {r["task_a"][1:]: r["leader"] for r in best.collect()}


def best_model(pairs: DataFrame, task: str, registry: Registry, cfg: ReuseConfig, weights: DataFrame | None = None) -> str | None:
    """``best_models`` of one task; None if no test has a result."""
    return best_models(distribution.histogram(of_task(pairs, task)), [task], registry, cfg, weights).get(task)


def predict(pairs: DataFrame, task: str, leader: str, registry: Registry) -> DataFrame:
    """``(src_a, src_b, id_a, id_b, leader, match, confidence)`` of one task."""
    return predict_all(of_task(pairs, task), {task: leader}, registry)


def predict_all(pairs: DataFrame, leaders: dict[str, str], registry: Registry) -> DataFrame:
    """``(src_a, src_b, id_a, id_b, leader, match, confidence)`` of all tasks that have a leader, in one narrow pass."""
    spark = pairs.sparkSession
    models = spark.sparkContext.broadcast({k: registry.models[k] for k in set(leaders.values())})  # a few small trees per model
    chosen = F.broadcast(spark.createDataFrame(list(leaders.items()), "task__ string, leader string"))  # a row per task

    @F.pandas_udf("double")
    def share(leader: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=x.index)
        for k, rows in x.groupby(leader):
            out[rows.index] = kernels.vote(models.value[k], np.stack(rows.to_numpy()).astype(float))
        return out

    rows = pairs.join(chosen, distribution.task_name() == F.col("task__")).withColumn("p", share("leader", "features"))
    return rows.select("src_a", "src_b", "id_a", "id_b", "leader", (F.col("p") >= 0.5).alias("match"), F.col("p").alias("confidence"))


def _by_task(pairs: DataFrame) -> DataFrame:
    """``pairs`` in folders by source pair, the rows of each spread over several files."""
    path = new_folder(pairs.sparkSession, "reuse-pairs")
    pairs.repartition("src_a", "src_b", F.pmod(F.xxhash64("id_a"), F.lit(16))).write.partitionBy("src_a", "src_b").parquet(path)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path)


def run(pairs: DataFrame, gold: DataFrame, cfg: ReuseConfig = ReuseConfig()) -> tuple[DataFrame, Registry]:
    """Predictions for all open tasks.

    A task can be searched once one of its sources is integrated; the next
    comparable task in arrival order is taken, classified, and its sources
    join the integrated ones. Tasks without a fitting model get a new one.
    Empty tasks do not exist in the pairs table. All waiting tasks are held
    against all models at once, and again only after a new model was trained;
    the predictions are one pass at the end, as models do not change.
    """
    pairs = _by_task(pairs)
    split = stage(budget.split_tasks(budget.task_sizes(pairs), cfg.split_ratio, cfg.seed), "reuse-split")
    registry = generate(pairs, gold, split, cfg)
    weights = stage(distribution.feature_weights(pairs), "reuse-weights")
    ready = {r["source"] for r in budget.integrated_sources(split).collect()}
    waiting = [(r["task"], r["src_a"], r["src_b"]) for r in split.where("not solved").orderBy("turn").collect()]
    hist = stage(distribution.histogram(pairs), "reuse-histogram") if waiting else None
    fits = best_models(hist, [w[0] for w in waiting], registry, cfg, weights) if waiting else {}
    leaders: dict[str, str] = {}
    while waiting:
        at = next((i for i, (_, a, b) in enumerate(waiting) if a.removesuffix("_test") in ready or b.removesuffix("_test") in ready), 0)
        task, a, b = waiting.pop(at)
        leader = fits.get(task)
        if leader is None or not registry.models.get(leader):
            train_cluster(pairs, gold, task, [task], cfg.new_task_budget, cfg, registry)
            leader = task
            fits = best_models(hist, [w[0] for w in waiting], registry, cfg, weights)
        registry.members[leader].append(task)
        leaders[task] = leader
        ready |= {a, b}
    if not leaders:
        return pairs.sparkSession.createDataFrame([], "src_a string, src_b string, id_a string, id_b string, leader string, match boolean, confidence double"), registry
    return stage(predict_all(pairs, leaders, registry), "reuse-predicted"), registry


def evaluate(predicted: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quality over all open tasks, and per model."""
    marked = predicted.select("leader", "match", F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"))
    return evaluation.per_group(marked, gold), evaluation.per_group(marked, gold, "leader")
