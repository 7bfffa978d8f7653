"""Graphs of records and of linkage tasks as edge tables ``(u, v, sim)`` with u < v."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.operators import kernels
from linkspark.operators.components import connected_components


def canonical(edges: DataFrame, u: str = "u", v: str = "v", sim: str = "sim") -> DataFrame:
    """Undirected edges once each, of the largest similarity."""
    return edges.where(f"{u} <> {v}").groupBy(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).agg(F.max(sim).alias("sim"))


def both_ways(edges: DataFrame, weight: str = "sim") -> DataFrame:
    """Every edge in both directions."""
    return edges.select("u", "v", weight).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), weight))


def existing_ends(edges: DataFrame, entities: DataFrame, iri: str = "iri") -> DataFrame:
    """Edges whose two ends are known entities."""
    known = entities.select(F.col(iri).alias("k")).distinct()
    return edges.join(known, F.col("u") == F.col("k"), "left_semi").join(known, F.col("v") == F.col("k"), "left_semi")


def link_types(edges: DataFrame, source_of: DataFrame, normal: bool = True) -> DataFrame:
    """``(u, v, sim, kind)``: edges that are the best to the other's source from both ends (strong) or one (normal); others go.

    ``source_of`` is ``(node, source)``.
    """
    s = source_of.select(F.col("node"), F.col("source"))
    e = edges.join(s.withColumnsRenamed({"node": "u", "source": "su"}), "u").join(s.withColumnsRenamed({"node": "v", "source": "sv"}), "v")
    long = e.select("u", "v", "sim", F.col("u").alias("me"), F.col("sv").alias("other")).unionByName(e.select("u", "v", "sim", F.col("v").alias("me"), F.col("su").alias("other")))
    top = long.select("u", "v", "sim", (F.col("sim") == F.max("sim").over(Window.partitionBy("me", "other"))).cast("int").alias("best"))
    votes = top.groupBy("u", "v", "sim").agg(F.sum("best").alias("votes"))
    kept = votes.where(F.col("votes") >= (1 if normal else 2))
    return kept.select("u", "v", "sim", F.when(F.col("votes") == 2, "strong").otherwise("normal").alias("kind"))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes; those without an edge are components of their own."""
    found = connected_components(edges)
    return nodes.select("node").distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def inferred(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Add ``graph_label`` (the ends are joined by a path) and ``cc_size`` (0 if not) to pairs ``(u, v)``."""
    size = comps.groupBy("component").agg(F.count("*").alias("size"))
    c = comps.join(size, "component")
    j = pairs.join(c.select(F.col("node").alias("u"), F.col("component").alias("cu"), "size"), "u", "left").join(c.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    same = F.coalesce(F.col("cu") == F.col("cv"), F.lit(False))
    return j.withColumn("graph_label", same).withColumn("cc_size", F.when(same, F.col("size")).otherwise(0)).drop("cu", "cv", "size")


def subgraph_of(node, edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges of the component that holds ``node``."""
    mine = comps.where(F.col("node") == node).select("component")
    inside = comps.join(mine, "component", "left_semi").select(F.col("node").alias("u"))
    return edges.join(inside, "u", "left_semi")


# --- the task graph ------------------------------------------------------------------------


def task_graph(tasks: DataFrame, sims: DataFrame, ratio: float = 1.0, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(task, node_id)`` numbered from 1 and edges ``(u, v, weight, distance)`` of similar tasks.

    With ``exact`` an edge needs similarity 1, else at least ``ratio``. There
    are as many nodes as source pairs, so one window numbers them.
    """
    nodes = tasks.select("task").distinct().withColumn("node_id", F.row_number().over(Window.orderBy("task")))
    kept = sims.where(F.col("similarity") == 1 if exact else F.col("similarity") >= ratio)
    a, b = nodes.withColumnsRenamed({"task": "task_a", "node_id": "a"}), nodes.withColumnsRenamed({"task": "task_b", "node_id": "b"})
    e = kept.join(a, "task_a").join(b, "task_b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("avg_similarity").alias("weight"))
    return nodes, e.groupBy("u", "v").agg(F.max("weight").alias("weight")).withColumn("distance", 1 - F.col("weight"))


def add_tasks(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Append tasks with the next free numbers; tasks that are there keep theirs."""
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top"))
    fresh = new.select("task").distinct().join(nodes, "task", "left_anti").withColumn("at", F.row_number().over(Window.orderBy("task")))
    return nodes.unionByName(fresh.crossJoin(F.broadcast(top)).select("task", (F.col("top") + F.col("at")).cast("int").alias("node_id")))


def modularity(edges: DataFrame, member: DataFrame, weight: str = "weight") -> DataFrame:
    """One row ``modularity`` of ``member`` (node, community)."""
    m = edges.agg(F.sum(weight).alias("m"))
    degree = both_ways(edges, weight).groupBy(F.col("u").alias("node")).agg(F.sum(weight).alias("d"))
    by = degree.join(member, "node").groupBy("community").agg(F.sum("d").alias("d"))
    inside = edges.join(member.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(member.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum(weight).alias("w"))
    q = by.join(inside, "community", "left").crossJoin(F.broadcast(m)).select((F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return q.agg(F.sum("q").alias("modularity"))


def _per_component(edges: DataFrame, run: Callable[[kernels.Edges, list[int]], dict], out: str, weight: str) -> DataFrame:
    """Run a kernel in each connected component of the task graph."""
    comps = connected_components(edges)
    marked = edges.join(comps.select(F.col("node").alias("u"), "component"), "u").select("component", "u", "v", F.col(weight).cast("double").alias("w"))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        e = sorted(zip(pdf["u"].astype(int), pdf["v"].astype(int), pdf["w"].astype(float), strict=True))
        nodes = sorted({x for u, v, _ in e for x in (u, v)})
        return pd.DataFrame(sorted(run(e, nodes).items()), columns=["node", out.split()[0]])

    return marked.groupBy("component").applyInPandas(go, f"node long, {out}")


def with_singletons(found: DataFrame, nodes: DataFrame, value) -> DataFrame:
    """Add nodes that no edge touches."""
    name = found.columns[1]
    return nodes.select(F.col("node_id").cast("long").alias("node")).join(found, "node", "left").withColumn(name, F.coalesce(F.col(name), value))


DETECTORS = ("louvain", "leiden", "label_propagation", "girvan_newman")


def communities(nodes: DataFrame, edges: DataFrame, method: str = "leiden", seed: int = 0) -> DataFrame:
    """``(node, community)`` by a named detector; communities never span components, so components run in parallel.

    Only the first split of ``girvan_newman`` looks at the whole task graph,
    which has one node per source pair.
    """
    if method not in DETECTORS:
        raise ValueError(f"unknown detector {method}; one of {DETECTORS}")
    if method == "girvan_newman":
        e = [(r["u"], r["v"], r["weight"]) for r in edges.select("u", "v", "weight").collect()]
        n = [r["node_id"] for r in nodes.select("node_id").collect()]
        return edges.sparkSession.createDataFrame([(int(u), int(c)) for u, c in kernels.first_split(sorted(n), e).items()], "node long, community long")
    total = edges.agg(F.sum("weight")).first()[0] or 1.0
    runs = {
        "louvain": lambda e, n: kernels.louvain(e, total, seed),
        "leiden": lambda e, n: kernels.louvain(e, total, seed, refine=True),
        "label_propagation": lambda e, n: kernels.label_propagation(e, seed),
    }
    return with_singletons(_per_component(edges, runs[method], "community long", "weight"), nodes, F.col("node"))


CENTRALITIES = ("closeness", "betweenness", "pagerank")


def centrality(edges: DataFrame, member: DataFrame, kind: str) -> DataFrame:
    """``(node, score)`` inside each community: closeness and betweenness by distance, PageRank by weight."""
    if kind not in CENTRALITIES:
        raise ValueError(f"unknown centrality {kind}; one of {CENTRALITIES}")
    weight = "weight" if kind == "pagerank" else "distance"
    m = member.select(F.col("node"), "community")
    inside = edges.join(m.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(m.withColumnsRenamed({"node": "v", "community": "cv"}), "v").where("cu = cv")
    rows = inside.select(F.col("cu").alias("community"), "u", "v", F.col(weight).alias("w")).unionByName(m.select("community", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("w")))
    run = {"closeness": kernels.closeness, "betweenness": kernels.betweenness, "pagerank": kernels.pagerank}[kind]

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.dropna()
        edges_ = sorted(zip(e["u"].astype(int), e["v"].astype(int), e["w"].astype(float), strict=True))
        nodes = sorted(set(pdf["u"].astype(int)))
        return pd.DataFrame(sorted(run(edges_, nodes).items()), columns=["node", "score"])

    return rows.withColumn("u", F.col("u").cast("long")).groupBy("community").applyInPandas(go, "node long, score double")


def diameters(edges: DataFrame, member: DataFrame) -> DataFrame:
    """``(community, diameter)`` by weighted distance."""
    m = member.select("node", "community")
    inside = edges.join(m.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(m.withColumnsRenamed({"node": "v", "community": "cv"}), "v").where("cu = cv")

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        e = list(zip(pdf["u"].astype(int), pdf["v"].astype(int), pdf["distance"].astype(float), strict=True))
        return pd.DataFrame({"community": [int(pdf["cu"].iloc[0])], "diameter": [kernels.diameter(e)]})

    return inside.select(F.col("cu").cast("long").alias("cu"), "u", "v", "distance").groupBy("cu").applyInPandas(go, "community long, diameter double")


def representatives(member: DataFrame, nodes: DataFrame, sizes: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``(community, task, score, rank, leader)``: members ranked by centrality averaged with relative size, or by size alone.

    Tasks inside one source rank last: their score is -1, or their size 0.
    ``sizes`` is ``(task, n, intra)``.
    """
    rows = member.join(nodes.select(F.col("node_id").cast("long").alias("node"), "task"), "node").join(sizes, "task")
    if scores is None:
        value = F.when(F.col("intra"), 0).otherwise(F.col("n")).cast("double")
    else:
        rows = rows.join(scores, "node")
        value = F.when(F.col("intra"), -1.0).otherwise((F.col("score") + F.col("n") / F.sum("n").over(Window.partitionBy("community"))) / 2)
    rows = rows.select("community", "task", value.alias("score"))
    order = Window.partitionBy("community").orderBy(F.desc("score"), "task")
    return rows.select("*", F.row_number().over(order).alias("rank"), F.first("task").over(order).alias("leader"))


def pagerank_rounds(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, weight: str = "weight") -> DataFrame:
    """``(node, rank)`` after a fixed number of rounds, as joins and sums for graphs of any size; nodes without edges spread evenly."""
    from linkspark.plans.staging import stage

    arcs = both_ways(edges, weight).withColumnRenamed(weight, "w")
    out = arcs.groupBy("u").agg(F.sum("w").alias("out"))
    share = stage(arcs.join(out, "u").select("u", "v", (F.col("w") / F.col("out")).alias("p")), "pagerank-arcs")
    ids = stage(nodes.select(F.col("node_id").cast("long").alias("node")).join(share.select(F.col("u").cast("long").alias("node")).distinct().withColumn("linked", F.lit(True)), "node", "left"), "pagerank-nodes")
    n = ids.count()
    rank = ids.select("node", F.lit(1.0 / max(n, 1)).alias("rank"), "linked")
    for i in range(rounds):
        sent = share.join(rank.select(F.col("node").alias("u"), "rank"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        loose = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(F.col("linked").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")))
        rank = ids.join(sent, "node", "left").crossJoin(loose).select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"), "linked")
        if i % 5 == 4:
            rank = stage(rank, "pagerank")
    return rank.select("node", "rank")


# --- correspondence graphs ---------------------------------------------------------------------


def correspondence(pairs: DataFrame, weighted: bool = True, remove_bridges: bool = True) -> DataFrame:
    """``(u, v)`` edges of the record graph after labels, bridges and cuts.

    ``pairs`` has ``u, v, predicted (bool), probability, label (bool, null if
    not labelled)``. Predicted and labelled matches are edges (of capacity
    probability and 100, or 1), labelled non-matches are none; loose bridges
    go, and labelled non-matches that a path still joins are cut apart.
    Components are worked off in parallel.
    """
    capacity = F.when(F.col("label"), 100.0).otherwise(F.col("probability")) if weighted else F.lit(1.0)
    match = F.coalesce("label", "predicted")
    edges = pairs.where(match).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max(capacity).alias("w"), F.max(F.coalesce("label", F.lit(False)).cast("int")).alias("sure"))
    apart = pairs.where("label = false").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = edges.join(apart, ["u", "v"], "left_anti")
    comps = connected_components(edges)
    rows = edges.join(comps.select(F.col("node").alias("u"), "component"), "u").select("component", "u", "v", "w", "sure", F.lit(0).alias("apart"))
    no = apart.join(comps.select(F.col("node").alias("u"), "component"), "u").join(comps.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v").where("component = cv")
    rows = rows.unionByName(no.select("component", "u", "v", F.lit(0.0).alias("w"), F.lit(0).alias("sure"), F.lit(1).alias("apart")))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf["apart"] == 0]
        edge = sorted(zip(e["u"].tolist(), e["v"].tolist(), e["w"].astype(float), strict=True))
        sure = set(zip(e["u"][e["sure"] == 1].tolist(), e["v"][e["sure"] == 1].tolist(), strict=True))
        if remove_bridges:
            gone = kernels.loose_bridges(edge, sure)
            edge = [x for x in edge if (x[0], x[1]) not in gone]
        n = pdf[pdf["apart"] == 1]
        edge = kernels.cut_apart(edge, sorted(zip(n["u"].tolist(), n["v"].tolist(), strict=True)))
        return pd.DataFrame([(u, v) for u, v, _ in edge], columns=["u", "v"])

    kind = edges.schema["u"].dataType.simpleString()
    return rows.groupBy("component").applyInPandas(go, f"u {kind}, v {kind}")
