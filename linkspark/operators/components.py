"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.plans.staging import stage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; ``component`` is its smallest node.

    Each round is two aggregations and two joins on edge lists, never a
    neighbour list in memory: the minimum per node combines map-side and the
    join back can be split when one node has very many neighbours. Rounds are
    written to the shared folder. Null ends and self loops without another
    edge give no component row for null and a singleton for the loop.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    e = stage(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        now = _print(e)
        if now == seen or not now[0]:
            break
        seen = now
        # large star: every node sends its larger neighbours to the smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = stage(e.where("u <> v"), "cc")
        # small star: smaller neighbours and the node itself go to the smallest one
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stage(e, "cc")
    else:
        if _print(e) != seen:
            raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    loops = loops.join(found, loops.u == found.node, "left_anti")
    return found.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")))
