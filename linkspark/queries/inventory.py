"""Readers, writers, scalar functions, registries and measures of the inventory, a query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.functions import registry, similarity, text, units
from linkspark.functions.registry import Comparison, ComparisonSpec
from linkspark.operators import classify, evaluation, graph, pairs, scores
from linkspark.operators import distribution as dist
from linkspark.plans.staging import new_folder
from linkspark.queries import query, table
from linkspark.queries.graphs import _EDGE_SQL, _price_edges, copies
from linkspark.queries.sources import csv_graph, json_graph
from linkspark.queries.statistics import _HIST_SQL, _PSI_SQL, _inputs
from linkspark.sources import features, graphs, offers, records

_TWO = "('LARGE', 'SMALL')"


# --- readers --------------------------------------------------------------------


@query("SRC-03_dispatch", "SELECT 'json' AS kind, CAST(n_nationkey AS VARCHAR) AS iri, CAST(n_regionkey AS VARCHAR) AS source FROM nation UNION ALL SELECT 'csv', CAST(p_partkey AS VARCHAR), p_type FROM part")
def src_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a folder in either format, told apart by its file names."""
    j, c = graphs.read_graph(spark, json_graph(spark, sf_dir))[0], graphs.read_graph(spark, csv_graph(spark, sf_dir))[0]
    return j.select(F.lit("json").alias("kind"), "iri", "source").unionByName(c.select(F.lit("csv").alias("kind"), "iri", "source"))


@query("SRC-04_dispatch_pair", "WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (0, 1)) SELECT CAST(s_nationkey AS VARCHAR) AS u, CAST(s_suppkey % 40 AS VARCHAR) AS v, CAST(0.5 AS DOUBLE) AS sim FROM supplier WHERE s_nationkey IN (SELECT k FROM n) AND s_suppkey % 40 IN (SELECT k FROM n)")
def src_dispatch_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the entities of two sources."""
    return graphs.read_graph(spark, json_graph(spark, sf_dir), ("0", "1"))[1]


@query("SRC-08_json_edges", "SELECT CAST(s_nationkey AS VARCHAR) AS u, count(*) AS n FROM supplier WHERE s_suppkey % 40 IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) GROUP BY 1")
def src_json_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which both ends are loaded entities, counted by their first."""
    base = json_graph(spark, sf_dir)
    known = graphs.read_json_vertices(spark, f"{base}/vertices.json").where("source <> '0'")
    return graphs.read_json_edges(spark, f"{base}/edges.json", known).groupBy("u").agg(F.count("*").alias("n"))


@query("SRC-10_csv_pair", f"SELECT CAST(p_partkey AS VARCHAR) AS iri, p_type AS source, p_name || ';x|y' AS name FROM part WHERE p_type IN {_TWO}")
def src_csv_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two sources of a CSV graph folder."""
    e, _ = graphs.read_graph(spark, csv_graph(spark, sf_dir), ("LARGE", "SMALL"))
    return e.select("iri", "source", F.element_at("props", "name").alias("name"))


@query("SRC-11_metadata", "SELECT DISTINCT p_type AS source, CAST(m.place AS INTEGER) AS place, m.name, m.type FROM part, (VALUES (0, 'gtId', 'int'), (1, 'name', 'string'), (2, 'price', 'double')) m(place, name, type)")
def src_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places, names and types of each source's attributes."""
    return graphs.read_metadata(spark, f"{csv_graph(spark, sf_dir)}/metadata.csv").withColumnRenamed("at", "place")


@query("SRC-12_csv_vertices", "SELECT p_type AS source, count(*) AS n, CAST(sum(length(p_name) + 4) AS BIGINT) AS name_chars, CAST(sum(p_size) AS BIGINT) AS sizes, round(sum(p_retailprice), 2) AS prices FROM part GROUP BY 1")
def src_csv_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with escaped separators and typed values, summed by source."""
    base = csv_graph(spark, sf_dir)
    v = graphs.read_csv_vertices(spark, f"{base}/vertices.csv", graphs.read_metadata(spark, f"{base}/metadata.csv"))
    p = {k: F.element_at("props", k) for k in ("name", "gtId", "price")}
    return v.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length(p["name"])).alias("name_chars"), F.sum(p["gtId"].cast("long")).alias("sizes"), F.round(F.sum(p["price"].cast("double")), 2).alias("prices"))


@query("SRC-13_csv_edges", "SELECT CAST(p_partkey AS VARCHAR) AS u, CAST(p_size AS VARCHAR) AS v, CAST(0.5 AS DOUBLE) AS sim FROM part WHERE p_size IN (SELECT p_partkey FROM part)")
def src_csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a CSV graph folder; both ends must exist."""
    return graphs.read_graph(spark, csv_graph(spark, sf_dir))[1]


@query("SRC-16_link_sets", "SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS part, least(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS lo, greatest(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS hi, o_orderstatus = 'F' AS label FROM orders")
def src_link_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training and a test file of labelled links."""
    base, o = new_folder(spark, "src-link-sets"), table(spark, sf_dir, "orders")
    line = F.concat_ws("#####", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"))
    for k, name in ((0, "train"), (1, "test")):
        o.where(F.pmod("o_orderkey", F.lit(2)) == k).select(line).write.text(f"{base}/{name}")
    return offers.read_link_sets(spark, f"{base}/train", f"{base}/test")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "src-embeddings")
    table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("token"), F.col("embedding").alias("vector")).write.parquet(path)
    return features.read_embeddings(spark, path)


@query("SRC-25_embeddings", "SELECT 'v' || vec_id AS token, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def src_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of word vectors."""
    return _dictionary(spark, sf_dir).select("token", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# --- writers --------------------------------------------------------------------


def _nation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_regionkey").cast("string").alias(f"src_{s}"), F.col("n_name").alias(f"id_{s}"), F.col("n_nationkey").alias(f"k{s}")) for s in "ab")
    return a.join(b, (F.col("ka") < F.col("kb")) & (F.col("src_a") <= F.col("src_b"))).select("src_a", "src_b", "id_a", "id_b", F.array(F.col("ka").cast("double"), F.col("kb").cast("double")).alias("features"))


_TASK_SQL = "WITH t AS (SELECT CAST(a.n_regionkey AS VARCHAR) AS src_a, CAST(b.n_regionkey AS VARCHAR) AS src_b, a.n_nationkey AS ka, b.n_nationkey AS kb FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <= b.n_regionkey) "


@query("SNK-01_task_files", _TASK_SQL + "SELECT src_a, src_b, count(*) AS n, CAST(sum(ka + kb) AS DOUBLE) AS total FROM t GROUP BY ALL")
def snk_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage tasks written by source pair and read back."""
    path = new_folder(spark, "snk-tasks")
    features.write_tasks(_nation_tasks(spark, sf_dir), path)
    return features.read_tasks(spark, path).groupBy("src_a", "src_b").agg(F.count("*").alias("n"), F.sum(F.col("features")[0] + F.col("features")[1]).alias("total"))


@query("SNK-02_no_empty_tasks", _TASK_SQL + "SELECT src_a, src_b, count(*) AS n FROM t WHERE src_a <> src_b AND ka % 7 > 2 GROUP BY ALL")
def snk_no_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that have rows left, without those inside one source: absent folders are empty tasks."""
    path = new_folder(spark, "snk-tasks")
    features.write_tasks(_nation_tasks(spark, sf_dir).where("features[0] % 7 > 2"), path)
    return features.read_tasks(spark, path, across_only=True).groupBy("src_a", "src_b").agg(F.count("*").alias("n"))


_RESULT_SQL = f"WITH {_EDGE_SQL}, c AS (SELECT t.r, count(*) FILTER (sim >= t.r) AS kept, count(*) AS n FROM e, (VALUES (0.7), (0.9)) t(r) GROUP BY 1) "


@query("SNK-04_result_rows", _RESULT_SQL + "SELECT CAST(r AS DOUBLE) AS ratio, kept, n, CAST(round(kept / n, 6) AS DOUBLE) AS share FROM c")
def snk_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row appended after each of two runs, read back."""
    path, e = new_folder(spark, "snk-result"), _price_edges(spark, sf_dir)
    for ratio in (0.7, 0.9):
        r = e.agg(F.count(F.when(F.col("sim") >= ratio, 1)).alias("kept"), F.count("*").alias("n")).first()
        features.append_result(spark, path, {"ratio": ratio, "kept": r["kept"], "n": r["n"], "share": round(r["kept"] / r["n"], 6)})
    return spark.read.option("header", True).schema("ratio double, kept long, n long, share double").csv(path)


@query("SNK-07_feature_csv", "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1 FROM embeddings")
def snk_feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors as CSV with header, read back."""
    path = new_folder(spark, "snk-features")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(2)))
    features.write_table(v, path)
    return spark.read.option("header", True).schema(v.schema).csv(path)


# --- projections, scalar functions, filters ---------------------------------------


@query("PRJ-01_pivot", "SELECT CAST(n_regionkey AS VARCHAR) AS source, CAST(n_nationkey AS VARCHAR) AS rec_id, n_name AS name, '' AS absent FROM nation")
def prj_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as rows of named columns; what an entity lacks is empty."""
    return records.pivot_sources(graphs.read_graph(spark, json_graph(spark, sf_dir))[0], ["name", "absent"])


@query("PRJ-03_flatten", "SELECT p_partkey, trim(p_name) AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) || ' x' END AS size FROM part")
def prj_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value out of bracketed lists, signs to blanks, ``null`` to empty."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("["), F.replace("p_name", F.lit(" "), F.lit("--")), F.lit(", other]"))
    size = F.when(F.col("p_size") % 2 == 0, "[null]").otherwise(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("/x]")))
    return p.select("p_partkey", text.flatten_property(name).alias("name"), text.flatten_property(size).alias("size"))


@query("SCL-04_first_present", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_name END, CASE WHEN p_size > 20 THEN p_brand END, p_type) AS dimensions FROM part")
def scl_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column that is there."""
    return table(spark, sf_dir, "part").select("p_partkey", units.first_present(F.when(F.col("p_size") > 40, F.col("p_name")), F.when(F.col("p_size") > 20, F.col("p_brand")), F.col("p_type")).alias("dimensions"))


@query("SCL-15_url_domain", "SELECT page_id, CASE WHEN regexp_matches(url, 'https?://[^/]+[/?]') THEN regexp_extract(url, 'https?://[^/?]+') END AS domain FROM pages")
def scl_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme and host of each page."""
    return table(spark, sf_dir, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"))


@query("SCL-17_attribute_of_feature", "SELECT f AS feature, a AS attribute FROM (VALUES ('p_name_dice', 'p_name'), ('p_name_edit', 'p_name'), ('p_retailprice_ratio', 'p_retailprice'), ('other', NULL)) t(f, a)")
def scl_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute behind a feature name: the longest column that it begins with."""
    named = spark.createDataFrame([(f,) for f in ("p_name_dice", "p_name_edit", "p_retailprice_ratio", "other")], "feature string")
    return named.select("feature", text.attribute_of(F.col("feature"), table(spark, sf_dir, "part").columns).alias("attribute"))


@query("SCL-18_nested", "SELECT p_partkey, p_size = 7 OR p_partkey % 10 = 7 AS held FROM part")
def scl_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any inner list holds a value."""
    lists = F.array(F.array(F.col("p_size").cast("long"), F.lit(0).cast("long")), F.array(F.col("p_partkey") % 10))
    return table(spark, sf_dir, "part").select("p_partkey", units.in_nested(lists, F.lit(7).cast("long")).alias("held"))


_TASKS = "t AS (SELECT DISTINCT a.source AS src_a, b.source AS src_b FROM documents a JOIN documents b ON a.source < b.source)"


@query("FLT-04_task_pairs", f"WITH {_TASKS} SELECT x.src_a AS a1, x.src_b AS b1, count(*) AS n FROM t x JOIN t y ON x.src_a <> y.src_a AND x.src_b <> y.src_b AND (x.src_a, x.src_b) < (y.src_a, y.src_b) GROUP BY ALL")
def flt_task_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that are compared with a task: neither first nor second source is shared."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    tasks = s.select(F.col("source").alias("src_a")).join(s.select(F.col("source").alias("src_b")), F.col("src_a") < F.col("src_b"))
    return pairs.task_pairs(tasks).groupBy("a1", "b1").agg(F.count("*").alias("n"))


@query("JOI-06_graph_label", "WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS c FROM documents) SELECT a.doc_id AS u, b.doc_id AS v, abs(a.n_chars - b.n_chars) AS gap, x.c = y.c AS graph_label FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 2 JOIN c x ON x.doc_id = a.doc_id JOIN c y ON y.doc_id = b.doc_id")
def joi_graph_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of unlabelled pairs with the label that the graph infers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = d.select(F.col("doc_id").alias("u"), (F.col("doc_id") + 2).alias("v"), F.col("n_chars").alias("x")).join(d.select(F.col("doc_id").alias("v"), F.col("n_chars").alias("y")), "v")
    labels = graph.inferred(rows.select("u", "v"), copies(spark, sf_dir)).select("u", "v", "graph_label")
    return rows.join(labels, ["u", "v"], "left").select("u", "v", F.abs(F.col("x") - F.col("y")).alias("gap"), "graph_label")


# --- similarities and registries ---------------------------------------------------


@query("SIM-03_q_and_padding", "SELECT p_partkey, CAST(len(list_intersect(g, h)) / CAST(len(list_distinct(list_concat(g, h))) AS DOUBLE) AS DOUBLE) AS sim FROM (SELECT p_partkey, list_distinct([substr(lower(p_name), i, 3) FOR i IN range(1, length(p_name) - 1)]) AS g, list_distinct([substr(lower(p_brand || p_name), i, 3) FOR i IN range(1, length(p_brand || p_name) - 1)]) AS h FROM part)")
def sim_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams without padding: both are arguments, no global modes."""
    p = table(spark, sf_dir, "part")
    g, h = (text.qgrams(F.lower(c), 3, "none") for c in (F.col("p_name"), F.concat("p_brand", "p_name")))
    return p.select("p_partkey", similarity.set_jaccard(g, h).alias("sim"))


_NEXT = "a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("FVS-11_embedding", f"SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim, CAST(0 AS DOUBLE) AS unknown FROM embeddings {_NEXT}")
def fvs_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the word vectors of two blank-stripped texts; 0 for a text out of the vocabulary."""
    words = _dictionary(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    two = e.join(e.select((F.col("vec_id") - 1).alias("vec_id")), "vec_id", "left_semi")
    name = lambda c: F.concat(F.lit("v "), c.cast("string"))
    rows = two.select("vec_id", name(F.col("vec_id")).alias("a"), name(F.col("vec_id") + 1).alias("b"), F.lit("no such word").alias("c"))
    known = features.embedding_similarity(rows, "a", "b", words, "sim")
    return features.embedding_similarity(known, "a", "c", words, "unknown").select("vec_id", F.round("sim", 5).alias("sim"), "unknown")


@query("UDF-01_own_comparison", "SELECT a.p_partkey AS id_a, b.p_partkey AS id_b, CAST(a.p_size = b.p_size AS DOUBLE) AS f0, CAST(left(a.p_name, 3) = left(b.p_name, 3) AS DOUBLE) AS f1 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey")
def udf_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison that a user registers, in a specification beside a built-in one."""
    registry.register("same_start", lambda a, b: (F.left(a, F.lit(3)) == F.left(b, F.lit(3))).cast("double"))
    spec = ComparisonSpec([Comparison("num_equal", "p_size"), Comparison("same_start", "p_name")])
    p = table(spark, sf_dir, "part")
    a, b = (p.select("p_brand", "p_name", F.col("p_partkey").alias(f"id_{s}"), F.struct("p_size", "p_name").alias(s)) for s in "ab")
    both = a.join(b, ["p_brand", "p_name"]).where("id_a < id_b")
    f = spec.features(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    return both.select("id_a", "id_b", f.alias("f")).select("id_a", "id_b", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1"))


@query("UDF-02_own_key", "SELECT left(p_name, 2) || '/' || p_size // 10 AS block, count(*) AS n FROM part GROUP BY 1")
def udf_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blocking key that a user registers, by name."""
    registry.register_key("start_and_decade", lambda name, size: F.concat_ws("/", F.left(name, F.lit(2)), F.floor(size / 10).cast("string")))
    key = registry.KEYS["start_and_decade"](F.col("p_name"), F.col("p_size"))
    return table(spark, sf_dir, "part").groupBy(key.alias("block")).agg(F.count("*").alias("n"))


@query("UDF-04_rules_by_name", f"WITH {_EDGE_SQL} SELECT k AS rule, count(*) FILTER (CASE k WHEN 'mean' THEN (sim + 1) / 2 >= 0.9 WHEN 'min' THEN sim >= 0.9 ELSE sim = 1 END) AS n FROM e, (VALUES ('mean'), ('min'), ('exact')) t(k) GROUP BY 1")
def udf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rules picked by their names."""
    e = _price_edges(spark, sf_dir).select(F.array("sim", F.lit(1.0)).alias("features"))
    counts = e.agg(*(F.count(F.when(classify.rule(k, 0.9), 1)).alias(k) for k in classify.RULES))
    return counts.unpivot([], list(classify.RULES), "rule", "n")


# --- statistics ------------------------------------------------------------------


@query("STA-13_pairwise_driver", _HIST_SQL + "SELECT task_a, task_b, CAST(feature AS INTEGER) AS feature, round(max(abs(f1 - f2)), 6) AS ks, round(sum(abs(f1 - f2) * step), 6) AS wasserstein FROM r GROUP BY ALL")
def sta_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All task pairs and features in one query, both statistics from the same running sums."""
    t = dist.ks_and_wasserstein(*_inputs(spark, sf_dir))
    return t.select("task_a", "task_b", "feature", F.round("ks", 6).alias("ks"), F.round("wasserstein", 6).alias("wasserstein"))


_VERDICT = "CASE WHEN min(CAST(s <= 0.1 AS INT)) = 1 THEN 1.0 ELSE round(avg(CAST(s < 0.1 AS DOUBLE)), 3) END"


@query("STA-15_verdicts", _HIST_SQL + _PSI_SQL + f", d AS (SELECT task_a, task_b, psi / (2 * ln((1 + 1e-6) / 1e-6)) AS s FROM p) SELECT task_a, task_b, CAST({_VERDICT} AS DOUBLE) AS similarity, round(avg(CASE WHEN 1 - s > 0.05 THEN 1 - s ELSE 0 END), 6) AS avg_similarity FROM d GROUP BY ALL HAVING {_VERDICT} >= 0")
def sta_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and mean similarity of each task pair that is similar at all."""
    stats = dist.long_form(dist.psi(*_inputs(spark, sf_dir)), "psi_scaled", "psi")
    return dist.similar(dist.similarity(stats)).select("task_a", "task_b", "similarity", F.round("avg_similarity", 6).alias("avg_similarity"))


# --- evaluation --------------------------------------------------------------------


_MATCH_SQL = f"WITH {_EDGE_SQL}, z AS (SELECT e.*, a.p_size = b.p_size OR abs(a.p_size - b.p_size) < 5 AS g FROM e JOIN part a ON a.p_partkey = u JOIN part b ON b.p_partkey = v), c AS (SELECT count(*) FILTER (sim >= 0.9 AND g) AS tp, count(*) FILTER (sim >= 0.9 AND NOT g) AS fp, count(*) FILTER (sim < 0.9 AND g) AS fn, count(*) AS n FROM z) "


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _price_edges(spark, sf_dir)
    size = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    g = e.join(size.select(F.col("p_partkey").alias("u"), F.col("p_size").alias("x")), "u").join(size.select(F.col("p_partkey").alias("v"), F.col("p_size").alias("y")), "v").where(F.abs(F.col("x") - F.col("y")) < 5)
    return e.select(F.col("u").alias("lo"), F.col("v").alias("hi"), (F.col("sim") >= 0.9).alias("match")), g.select(F.col("u").alias("lo"), F.col("v").alias("hi"))


@query("EVA-02_measures", _MATCH_SQL + "SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def eva_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision, recall and F of classified pairs."""
    p, g = _predicted(spark, sf_dir)
    c = evaluation.confusion(p, g, p.count(), ("lo", "hi"))
    return c.select(*(F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")))


@query("EVA-09_f_star", _MATCH_SQL + "SELECT tp, fp, fn, round(tp / (tp + fp + fn), 6) AS f_star FROM c")
def eva_f_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tp / (tp + fp + fn) of two link sets."""
    p, g = _predicted(spark, sf_dir)
    return evaluation.link_quality(p.where("match"), g).select("tp", "fp", "fn", F.round("f_star", 6).alias("f_star"))


# --- classifiers -------------------------------------------------------------------


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("features"), (F.pmod("label", F.lit(2)) == 1).cast("double").alias("label"))


@query("CLS-06_apply")
def cls_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their probability, non-matches without, by a tree."""
    v = _labelled_vectors(spark, sf_dir)
    out = classify.apply(v, classify.train(v, "dt"))
    return out.select("vec_id", "prediction", F.when(F.col("prediction"), F.round("confidence", 6)).alias("probability"))


@query("CLS-07_factory")
def cls_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training accuracy of every classifier that the factory makes."""
    v = _labelled_vectors(spark, sf_dir)
    found = None
    for name in classify.CLASSIFIERS:
        a = classify.apply(v, classify.train(v, name)).agg(F.round(F.avg((F.col("prediction") == (F.col("label") == 1)).cast("double")), 6).alias("accuracy")).select(F.lit(name).alias("classifier"), "accuracy")
        found = a if found is None else found.unionByName(a)
    return found


@query("CLS-08_importances")
def cls_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each feature to a tree and to a linear model."""
    v = _labelled_vectors(spark, sf_dir)
    rows = [(name, i, x) for name in ("dt", "logr") for i, x in enumerate(classify.importances(classify.train(v, name)))]
    return spark.createDataFrame(rows, "classifier string, feature int, importance double")


# --- sorting, windows, thresholds ------------------------------------------------------


@query("SRT-03_sorted_lists", f"WITH {_EDGE_SQL} SELECT u, string_agg(CAST(v AS VARCHAR), ',' ORDER BY sim DESC, v) AS others FROM e GROUP BY 1")
def srt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each resource's edges, the most alike first."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "v")))
    return _price_edges(spark, sf_dir).groupBy("u").agg(F.array_join(F.transform(listed, lambda s: s["v"].cast("string")), ",").alias("others"))


@query("WIN-02_ranks", "SELECT o_orderkey, rank() OVER c AS place, dense_rank() OVER c AS dense, CAST(lag(o_totalprice) OVER o AS DOUBLE) AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderpriority), o AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def win_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking, offset and frame functions within each customer's orders."""
    by, seq = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(by).cast("long").alias("place"), F.dense_rank().over(by).cast("long").alias("dense"), F.lag("o_totalprice").over(seq).alias("before"), F.count("*").over(seq.rowsBetween(-2, 0)).alias("near"))


@query("AGG-21_source_counts", "SELECT n AS tasks, CAST((SELECT min(k) FROM range(2, 200) t(k) WHERE k * (k - 1) / 2 >= n) AS INTEGER) AS sources FROM (SELECT DISTINCT n_regionkey * 7 + n_nationkey + 1 AS n FROM nation)")
def agg_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest number of sources that makes so many source pairs, for several numbers."""
    n = [r[0] for r in table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 7 + F.col("n_nationkey") + 1).alias("n")).distinct().collect()]
    return spark.createDataFrame([(x, scores.sources_of(x)) for x in n], "tasks int, sources int")
