"""Splitting tasks into solved and open ones, and dealing out the labelling budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators.distribution import task_name


def task_sizes(pairs: DataFrame) -> DataFrame:
    """``(task, src_a, src_b, n, intra)``."""
    return named_sizes(pairs.groupBy("src_a", "src_b").agg(F.count("*").alias("n")))


def named_sizes(counts: DataFrame) -> DataFrame:
    """The same from ``(src_a, src_b, n)``, where the pairs are counted already."""
    return counts.select(task_name().alias("task"), "src_a", "src_b", "n", (F.col("src_a") == F.col("src_b")).alias("intra"))


def split_tasks(sizes: DataFrame, ratio: float = 0.5, seed: int | None = None) -> DataFrame:
    """Add ``solved`` and ``turn``: the first ``round(ratio * n)`` tasks by name are solved, the others arrive by name or in a seeded order."""
    at = F.row_number().over(Window.orderBy("task"))
    n = F.count("*").over(Window.partitionBy())
    marked = sizes.withColumn("solved", at <= F.bround(n * ratio, 0))
    order = [F.col("task")] if seed is None else [F.xxhash64("task", F.lit(seed)), F.col("task")]
    return marked.withColumn("turn", F.when(~F.col("solved"), F.row_number().over(Window.partitionBy("solved").orderBy(*order))))


def split_by_pairs(pairs: DataFrame, train: DataFrame, test: DataFrame, least: int = 10) -> DataFrame:
    """Pairs that are listed for training (sources renamed with ``_train``, tasks of more than ``least`` pairs only) and for testing; add ``part``."""
    on = ["id_a", "id_b"]
    learn = pairs.join(train.select(*on).distinct(), on, "left_semi")
    big = learn.groupBy("src_a", "src_b").agg(F.count("*").alias("n")).where(F.col("n") > least).select("src_a", "src_b")
    learn = learn.join(big, ["src_a", "src_b"], "left_semi")
    learn = learn.withColumns({s: F.concat(F.col(s), F.lit("_train")) for s in ("src_a", "src_b")}).withColumn("part", F.lit("train"))
    return learn.unionByName(pairs.join(test.select(*on).distinct(), on, "left_semi").withColumn("part", F.lit("test")))


def integrated_sources(split: DataFrame) -> DataFrame:
    """Sources of solved tasks."""
    return split.where("solved").select(F.explode(F.array("src_a", "src_b")).alias("source")).distinct()


def allocate(ranked: DataFrame, sizes: DataFrame, least: int, total: int) -> DataFrame:
    """``(leader, members, size, budget)`` of all clusters, as window sums over a table of clusters.

    Every cluster gets ``least`` labels. The rest is dealt to communities by
    their share of all tasks and then by size, and to single tasks by size.
    If the minima exceed the total, single tasks count as without a minimum
    and the caller merges some of them (``merge_singletons``); if even the
    communities' minima do, that is an error.
    """
    c = ranked.join(sizes.select("task", "n", "intra"), "task").groupBy("leader").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    all_ = Window.partitionBy()
    com = F.col("members") > 1
    row = c.select("*", com.alias("com"), F.count("*").over(all_).alias("clusters"), F.sum(com.cast("int")).over(all_).alias("coms"), F.sum(F.when(com, F.col("members")).otherwise(0)).over(all_).alias("com_tasks"), F.sum("members").over(all_).alias("tasks"), F.sum("size").over(Window.partitionBy(com)).alias("kind_size"))
    too_few = row.select(F.max(F.col("coms") * least)).first()[0]
    if too_few is not None and too_few > total:
        raise ValueError(f"the minimum of {too_few} exceeds the total budget of {total}")
    naive = F.col("clusters") * least <= total
    rest = F.when(naive, total - F.col("clusters") * least).otherwise(total - F.col("coms") * least)
    for_com = F.ceil(F.col("com_tasks") / F.col("tasks") * rest)
    part = F.when(F.col("com"), for_com).otherwise(rest - for_com)
    return row.select("leader", "members", "size", F.ceil(least + F.col("size") / F.col("kind_size") * part).cast("int").alias("budget"), naive.alias("fits"), (rest - for_com).cast("double").alias("rest_single"))


def merge_singletons(allocated: DataFrame, sims: DataFrame, ranked: DataFrame, sizes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """For minima that do not fit: the most dissimilar single tasks keep a share, the others join the most similar community.

    Returns the new ranking ``(leader, task, score)`` and ``(leader, budget)``.
    ``sims`` is ``(task_a, task_b, avg_similarity)`` in either order. Tasks
    that are similar to no community come first, then the least similar ones,
    each taking its size's share of what is left for single tasks.
    """
    singles = allocated.where("members = 1").select(F.col("leader").alias("task"), "size", "rest_single").join(sizes.select("task", "intra"), "task")
    com = ranked.join(allocated.where("members > 1").select("leader"), "leader").select("leader", F.col("task").alias("other"))
    both = sims.select("task_a", "task_b", "avg_similarity").unionByName(sims.select(F.col("task_b").alias("task_a"), F.col("task_a").alias("task_b"), "avg_similarity"))
    to_com = both.join(com, both.task_b == com.other).groupBy(F.col("task_a").alias("task"), "leader").agg(F.avg("avg_similarity").alias("sim"))
    best = to_com.groupBy("task").agg(F.max_by("leader", F.struct("sim", "leader")).alias("nearest"), F.max("sim").alias("sim"))
    ordered = singles.join(best, "task", "left").where("not intra")
    all_ = Window.partitionBy()
    share = F.col("size") / F.sum("size").over(all_) * F.col("rest_single")
    upto = Window.orderBy(F.col("sim").asc_nulls_first(), "task").rowsBetween(Window.unboundedPreceding, -1)
    dealt = ordered.withColumn("share", share)
    dealt = dealt.withColumn("before", F.coalesce(F.sum("share").over(upto), F.lit(0.0)))
    keeps = dealt.where(F.col("nearest").isNull() | (F.col("before") < F.col("rest_single"))).withColumn("got", F.greatest(F.least("share", F.col("rest_single") - F.col("before")), F.lit(0.0)))
    gone = singles.join(keeps.select("task"), "task", "left_anti").join(best, "task")
    new_ranked = ranked.join(gone.select("task"), "task", "left_anti").select("leader", "task", "score").unionByName(gone.select(F.col("nearest").alias("leader"), "task", F.lit(0.0).alias("score")))
    budgets = allocated.where("members > 1").select("leader", "budget").unionByName(keeps.select(F.col("task").alias("leader"), F.ceil(least + F.col("got")).cast("int").alias("budget")))
    rest = allocated.where("members = 1").select("leader").join(budgets.select("leader"), "leader", "left_anti").join(gone.select(F.col("task").alias("leader")), "leader", "left_anti")
    return new_ranked, budgets.unionByName(rest.select("leader", F.lit(least).cast("int").alias("budget")))
