"""Smaller operators of the inventory: filters, votes, summaries, predicates on graphs, and shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import distribution as dist
from linkspark.operators import evaluation, graph, pairs, scores, taskprofile
from linkspark.plans.staging import new_folder, stage
from linkspark.queries import query, table
from linkspark.queries.graphs import _EDGE_SQL, _price_edges, copies
from linkspark.queries.learning import _FLAGSHIP, document_pairs
from linkspark.queries.relational import _GOLD, part_gold
from linkspark.queries.similarity import _VECTOR_SQL, part_features, part_records


@query("FLT-03_no_self", "SELECT a.user_id AS u, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY 1")
def flt_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of a record with itself are left out in the join condition."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    a, b = e.withColumnRenamed("event_type", "x"), e.withColumnRenamed("event_type", "y")
    return a.join(b, "user_id").where("x <> y").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"))


@query("FLT-05_integrated", "WITH t AS (SELECT DISTINCT a.source AS a, b.source AS b FROM documents a JOIN documents b ON a.source < b.source), i AS (SELECT DISTINCT source FROM documents WHERE lang = 'fr' AND n_chars > 4000) SELECT a, b FROM t WHERE a IN (SELECT source FROM i) OR b IN (SELECT source FROM i)")
def flt_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with an integrated source: two semi joins over source names."""
    d = table(spark, sf_dir, "documents")
    s = d.select("source").distinct()
    t = s.select(F.col("source").alias("a")).crossJoin(s.select(F.col("source").alias("b"))).where("a < b")
    i = d.where("lang = 'fr' and n_chars > 4000").select("source").distinct()
    left, right = (t.join(i, t[c] == i.source, "left_semi") for c in "ab")
    return left.union(right).distinct()


@query("FLT-06_edges_by_ratio", f"WITH {_EDGE_SQL} SELECT u, v, sim FROM e WHERE sim >= 0.8")
def flt_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of at least a ratio."""
    return _price_edges(spark, sf_dir).where("sim >= 0.8")


@query("FLT-08_listed", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def flt_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed groups."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("FLT-09_clean_components", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n <= 2")
def flt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of components of at most two."""
    c = copies(spark, sf_dir)
    small = c.groupBy("component").agg(F.count("*").alias("n")).where("n <= 2")
    return c.join(small, "component", "left_semi").select(F.col("node").alias("doc_id"))


@query("AGG-02_cluster_means", f"WITH {_EDGE_SQL} SELECT u AS single_task, sv AS cluster, round(avg(sim), 6) AS avg_similarity FROM e GROUP BY ALL")
def agg_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of a node to each cluster."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_type").alias("cluster"))
    return _price_edges(spark, sf_dir).join(s, "v").groupBy(F.col("u").alias("single_task"), "cluster").agg(F.round(F.avg("sim"), 6).alias("avg_similarity"))


@query("AGG-13_vote_share", _VECTOR_SQL + "SELECT id_a, id_b, round((CAST(f[1] >= 0.5 AS INT) + CAST(f[2] >= 0.5 AS INT) + CAST(f[3] >= 0.5 AS INT) + CAST(f[4] >= 0.5 AS INT) + CAST(f[5] >= 0.5 AS INT)) / 5, 6) AS p FROM v")
def agg_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of single-feature rules that vote for a match."""
    votes = F.size(F.filter("features", lambda x: x >= 0.5)) / F.size("features")
    return part_features(spark, sf_dir).select("id_a", "id_b", F.round(votes, 6).alias("p"))


@query("AGG-21_sources", "SELECT CAST(6 AS INTEGER) AS n")
def agg_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sources that the number of source pairs implies."""
    n = pairs.task_counts(part_records(spark, sf_dir)).count()
    return spark.createDataFrame([(scores.sources_of(n),)], "n int")


@query("AGG-23_task_summary", _VECTOR_SQL + f", {_GOLD} SELECT (SELECT count(*) FROM part) AS records_source, (SELECT count(*) FROM part) AS records_target, count(*) AS n_pairs, count(g.id_a) AS matches, count(*) - count(g.id_a) AS non_matches, round(count(g.id_a) / count(*), 6) AS ratio_pos, CAST(5 AS INTEGER) AS n_features, CAST(1 AS DOUBLE) AS avg_density FROM v LEFT JOIN gold g ON g.id_a = v.id_a AND g.id_b = v.id_b")
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the part pairs as one matching task."""
    p = table(spark, sf_dir, "part")
    rows = part_features(spark, sf_dir).join(part_gold(spark, sf_dir).withColumn("g", F.lit(1)), ["id_a", "id_b"], "left").select("features", F.coalesce("g", F.lit(0)).alias("label"))
    return taskprofile.summary(p, p, rows).withColumn("ratio_pos", F.round("ratio_pos", 6))


@query("AGG-23_best_thresholds", _VECTOR_SQL + f", {_GOLD}, l AS (SELECT i - 1 AS feature, floor(round(f[i] * 100, 9)) AS c, CAST(g.id_a IS NOT NULL AS INT) AS y FROM v LEFT JOIN gold g ON g.id_a = v.id_a AND g.id_b = v.id_b, (SELECT unnest(range(1, 6)) AS i)), e AS (SELECT feature, t, sum(CASE WHEN c >= t THEN 1 - y ELSE y END) AS errors FROM (SELECT feature, c, y FROM l), (SELECT unnest(range(0, 101)) AS t) GROUP BY ALL) SELECT CAST(feature AS INTEGER) AS feature, arg_min(t, (errors, t)) / 100 AS threshold, CAST(min(errors) AS BIGINT) AS errors FROM e GROUP BY feature")
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best threshold of every feature."""
    rows = part_features(spark, sf_dir).join(part_gold(spark, sf_dir).withColumn("g", F.lit(1)), ["id_a", "id_b"], "left").select("features", F.coalesce("g", F.lit(0)).alias("label"))
    return taskprofile.best_thresholds(rows)


@query("GRF-17_subgraph_of_node", f"WITH RECURSIVE {_EDGE_SQL}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), s AS (SELECT (SELECT min(u) FROM e) AS node UNION SELECT b.v FROM s JOIN b ON b.u = s.node) SELECT u, v, sim FROM e WHERE u IN (SELECT node FROM s)")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the component of the smallest node."""
    e = stage(_price_edges(spark, sf_dir), "subgraph")
    node = e.agg(F.min("u")).first()[0]
    return graph.subgraph_of(node, e, graph.connected_components(e))


@query("EVA-06_edges_against_clusters", f"WITH {_EDGE_SQL}, g AS (SELECT DISTINCT a.p_partkey AS lo, b.p_partkey AS hi FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey), c AS (SELECT (SELECT count(*) FROM e JOIN g ON lo = u AND hi = v) AS tp, (SELECT count(*) FROM e) AS nf, (SELECT count(*) FROM g) AS ng) SELECT tp, nf - tp AS fp, ng - tp AS fn, round(tp / nf, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (nf + ng), 6) AS f1, round(tp / (nf + ng - tp), 6) AS f_star FROM c")
def edges_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges against the pairs of gold clusters."""
    g = evaluation.cluster_links(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("c"), "p_partkey"), "c", "p_partkey")
    q = evaluation.link_quality(_price_edges(spark, sf_dir).toDF("lo", "hi", "sim"), g)
    return q.select("tp", "fp", "fn", *(F.round(k, 6).alias(k) for k in ("precision", "recall", "f1", "f_star")))


@query("STA-06_missing_convention", "SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 AND p_partkey % 3 = 0 THEN 0.06 WHEN p_size % 3 = 0 OR p_partkey % 3 = 0 THEN 0.04 ELSE 0.5 END AS DOUBLE) AS ks, CAST(CASE WHEN p_size % 3 = 0 AND p_partkey % 3 = 0 THEN 0.9 WHEN p_size % 3 = 0 OR p_partkey % 3 = 0 THEN 0.2 ELSE 0.5 END AS DOUBLE) AS other FROM part")
def missing_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed results for empty sides."""
    a, b = F.col("p_size") % 3, F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", dist.missing_convention(a, b, F.lit(0.5), True).alias("ks"), dist.missing_convention(a, b, F.lit(0.5), False).alias("other"))


@query("SRC-20_cached_tests", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def cached_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table cached as Parquet and read again."""
    from linkspark.sources.features import write_table

    path = new_folder(spark, "cached-tests")
    write_table(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), path, "parquet")
    return spark.read.parquet(path)


@query("SRC-22_long_features", _VECTOR_SQL + "SELECT CAST(i - 1 AS INTEGER) AS feature, count(f[i]) AS n, round(avg(f[i]), 6) AS mean FROM v, (SELECT unnest(range(1, 6)) AS i) GROUP BY i")
def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors in long form, averaged."""
    f = part_features(spark, sf_dir).select(F.posexplode("features").alias("feature", "x"))
    return f.groupBy("feature").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query("TOP-04_prefix", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of an explicit order (a top-k report)."""
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id").limit(50)


@query("SRT-01_ranked", _FLAGSHIP + "SELECT id_a, id_b, row_number() OVER (PARTITION BY src_a, src_b ORDER BY round((words + dice + size) / 3, 6) DESC, id_a, id_b) AS place FROM p")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs of each task by score."""
    from pyspark.sql import Window

    score = F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / 3, 6)
    w = Window.partitionBy("src_a", "src_b").orderBy(score.desc(), "id_a", "id_b")
    return document_pairs(spark, sf_dir).select("id_a", "id_b", F.row_number().over(w).cast("long").alias("place"))
