"""Graph operators on document and task graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import graph, pairs, scores
from linkspark.plans import budget, reuse
from linkspark.plans.staging import stage
from linkspark.queries import query, table
from linkspark.queries.similarity import part_features, part_records

_CC_SQL = """WITH RECURSIVE e AS (SELECT o_custkey AS u, l_suppkey + 1000000 AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber >= 6),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT DISTINCT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node"""


def _bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber >= 6")
    o = table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v"))


@query("GRF-02_components", _CC_SQL)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers and suppliers that late returned lines join."""
    return graph.connected_components(_bipartite(spark, sf_dir))


@query("GRF-02_copies", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents with equal texts; each links to the smallest id."""
    d = table(spark, sf_dir, "documents")
    low = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("v"))
    e = d.select(F.col("doc_id").alias("u"), F.sha2("text", 256).alias("h")).join(low, "h").where("u <> v").select("u", "v")
    return graph.clusters(d.select(F.col("doc_id").alias("node")), e)


_EDGE_SQL = "e AS (SELECT a.p_partkey AS u, b.p_partkey AS v, a.p_type AS su, b.p_type AS sv, round(least(a.p_retailprice, b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice), 4) AS sim FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_type <> b.p_type)"


def _price_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = (p.select("p_name", "p_brand", F.col("p_partkey").alias(n), F.col("p_type").alias(f"s{n}"), F.col("p_retailprice").alias(f"r{n}")) for n in "uv")
    e = a.join(b, ["p_name", "p_brand"]).where("u < v and su <> sv")
    return e.select("u", "v", F.round(F.least("ru", "rv") / F.greatest("ru", "rv"), 4).alias("sim"))


@query("GRF-01_similarity_graph", f"WITH {_EDGE_SQL} SELECT u, v, sim FROM e")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of one name and brand."""
    e = _price_edges(spark, sf_dir)
    return graph.canonical(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")))


@query("GRF-03_link_types", f"WITH {_EDGE_SQL}, l AS (SELECT u, v, sim, u AS me, sv AS other FROM e UNION ALL SELECT u, v, sim, v, su FROM e), b AS (SELECT u, v, sim, CAST(sim = max(sim) OVER (PARTITION BY me, other) AS INT) AS best FROM l) SELECT u, v, sim, CASE WHEN sum(best) = 2 THEN 'strong' ELSE 'normal' END AS kind FROM b GROUP BY u, v, sim HAVING sum(best) >= 1")
def link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and normal links between sources."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("source"))
    return graph.link_types(_price_edges(spark, sf_dir), s)


@query("GRF-21_inferred_labels", "WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS c, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT a.doc_id AS u, b.doc_id AS v, a.c = b.c AS graph_label, CASE WHEN a.c = b.c THEN a.n ELSE 0 END AS cc_size FROM c a JOIN c b ON b.doc_id = a.doc_id + 1")
def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether neighbouring ids are joined by a path, and the size of their component."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("u"))
    p = d.select("u", (F.col("u") + 1).alias("v")).join(d.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    return graph.inferred(p, copies(spark, sf_dir)).select("u", "v", "graph_label", F.col("cc_size").cast("long").alias("cc_size"))


@query("GRF-23_component_sizes", "SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM documents GROUP BY text) GROUP BY 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components per size."""
    return scores.size_histogram(copies(spark, sf_dir), "component")


def task_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, nodes and edges of the part tasks by Wasserstein similarity."""
    f = stage(part_features(spark, sf_dir), "graph-pairs")
    sizes = stage(budget.task_sizes(f), "graph-sizes")
    sims = reuse.task_similarities(f, sizes, reuse.ReuseConfig(test="wasserstein"))
    nodes, edges = graph.task_graph(sizes, sims, 0.8, exact=False)
    return sizes, stage(nodes, "graph-nodes"), stage(edges, "graph-edges")


@query("GRF-04_task_graph")
def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the task graph."""
    return task_graph(spark, sf_dir)[2]


@query("GRF-05_add_tasks", "SELECT s AS task, CAST(row_number() OVER (ORDER BY k, s) AS INTEGER) AS node_id FROM (SELECT p_type AS s, 0 AS k FROM part UNION SELECT o_orderpriority, 1 FROM orders)")
def add_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with new ones appended."""
    nodes, _ = graph.task_graph(table(spark, sf_dir, "part").select(F.col("p_type").alias("task")), spark.createDataFrame([], "task_a string, task_b string, similarity double, avg_similarity double"))
    return graph.add_tasks(nodes, table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task")))


def _communities(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, nodes, edges = task_graph(spark, sf_dir)
        return graph.communities(nodes, edges, method).withColumn("community", F.col("community").cast("long"))

    run.__doc__ = f"Communities of the task graph by {method}."
    return run


for _name, _method in (("GRF-06_louvain", "louvain"), ("GRF-07_leiden", "leiden"), ("GRF-08_girvan_newman", "girvan_newman"), ("GRF-09_label_propagation", "label_propagation")):
    query(_name)(_communities(_method))


@query("GRF-10_modularity", "WITH e AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(count(*) AS DOUBLE) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), m AS (SELECT sum(weight) AS m FROM e), d AS (SELECT n_regionkey AS c, sum(weight) AS d FROM (SELECT u AS k, weight FROM e UNION ALL SELECT v, weight FROM e) JOIN nation ON n_nationkey = k GROUP BY 1), i AS (SELECT a.n_regionkey AS c, sum(weight) AS w FROM e JOIN nation a ON a.n_nationkey = u JOIN nation b ON b.n_nationkey = v WHERE a.n_regionkey = b.n_regionkey GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM d LEFT JOIN i USING (c), m")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the regions in the trade graph of nations."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).where("c_nationkey <> s_nationkey")
    e = j.groupBy(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v")).agg(F.count("*").cast("double").alias("weight"))
    member = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return graph.modularity(e, member).select(F.round("modularity", 6).alias("modularity"))


def _pagerank_sql(rounds: int) -> str:
    sql = "WITH e AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(count(*) AS DOUBLE) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), a AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e), p AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS p FROM a), n AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation), r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM n) AS r FROM n)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce((SELECT sum(p * r) FROM p JOIN r{i} q ON q.node = p.u WHERE p.v = n.node), 0) + coalesce((SELECT sum(r) FROM r{i} WHERE node NOT IN (SELECT u FROM a)), 0) / (SELECT count(*) FROM n)) AS r FROM n)"
    return sql + f" SELECT node, round(r, 6) AS rank FROM r{rounds}"


@query("GRF-13_pagerank", _pagerank_sql(8))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the trade graph of nations after eight rounds."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).where("c_nationkey <> s_nationkey")
    e = stage(j.groupBy(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v")).agg(F.count("*").cast("double").alias("weight")), "trade")
    return graph.pagerank_rounds(e, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node_id")), 8).select("node", F.round("rank", 6).alias("rank"))


def _centrality(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, nodes, edges = task_graph(spark, sf_dir)
        return graph.centrality(edges, graph.communities(nodes, edges, "leiden"), kind)

    run.__doc__ = f"{kind} of the tasks inside their communities."
    return run


for _kind in graph.CENTRALITIES:
    query(f"GRF-13_{_kind}_in_communities")(_centrality(_kind))


@query("GRF-15_representatives")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each community in order, with their leader."""
    sizes, nodes, edges = task_graph(spark, sf_dir)
    member = graph.communities(nodes, edges, "leiden")
    return graph.representatives(member, nodes, sizes, graph.centrality(edges, member, "betweenness"))


@query("GRF-14_largest_task", "WITH s AS (SELECT a.p_type || '|' || b.p_type AS task, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type < b.p_type GROUP BY 1) SELECT CAST(1 AS BIGINT) AS community, task, CAST(n AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY n DESC, task) AS INTEGER) AS rank, first(task) OVER (ORDER BY n DESC, task) AS leader FROM s")
def largest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks as one community, ranked by size."""
    sizes = stage(budget.named_sizes(pairs.task_counts(part_records(spark, sf_dir))), "sizes")
    nodes, _ = graph.task_graph(sizes, spark.createDataFrame([], "task_a string, task_b string, similarity double, avg_similarity double"))
    member = nodes.select(F.col("node_id").cast("long").alias("node"), F.lit(1).cast("long").alias("community"))
    return graph.representatives(member, nodes, sizes)


@query("GRF-16_diameters")
def diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted diameter of each community."""
    _, nodes, edges = task_graph(spark, sf_dir)
    return graph.diameters(edges, graph.communities(nodes, edges, "leiden"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _price_edges(spark, sf_dir)
    h = F.pmod(F.xxhash64("u", "v"), F.lit(10))
    return e.select("u", "v", (F.col("sim") >= 0.9).alias("predicted"), F.col("sim").alias("probability"), F.when(h == 0, F.lit(True)).when(h == 1, F.lit(False)).alias("label"))


@query("GRF-19_correspondence")
def correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted correspondence graph after labels, bridges and cuts."""
    return graph.correspondence(_predictions(spark, sf_dir))


@query("GRF-20_correspondence_unweighted")
def correspondence_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with capacities of 1 and bridges kept."""
    return graph.correspondence(_predictions(spark, sf_dir), weighted=False, remove_bridges=False)


@query("GRF-22_graph_quality")
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that the correspondence graph implies against those of high similarity."""
    from linkspark.operators import evaluation

    edges = graph.correspondence(_predictions(spark, sf_dir))
    comps = graph.connected_components(edges)
    e = _price_edges(spark, sf_dir)
    found = graph.inferred(e.select("u", "v"), comps).where("graph_label").select(F.col("u").alias("lo"), F.col("v").alias("hi"))
    return evaluation.link_quality(found, e.where("sim >= 0.9").select(F.col("u").alias("lo"), F.col("v").alias("hi")))
