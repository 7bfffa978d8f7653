"""Readers and writers, each over a file written from a driver table and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions.text import url_domain
from linkspark.operators import scores
from linkspark.plans.staging import new_folder
from linkspark.queries import query, table
from linkspark.queries.similarity import part_features
from linkspark.sources import features, graphs, offers, records


@query("SRC-01_records", "SELECT lower(trim(CAST(c_custkey AS VARCHAR))) AS c_custkey, lower(c_name) AS c_name, '' AS c_mktsegment FROM customer")
def src_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with one attribute blanked and repeated ids."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = new_folder(spark, "src-records")
    c.unionByName(c.where("c_custkey <= 20")).coalesce(1).write.option("header", True).option("compression", "gzip").csv(path)
    return records.read_records(spark, path, "c_custkey", ["c_name"])


@query("SRC-02_truth", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id_a, CAST(l_suppkey AS VARCHAR) AS id_b FROM lineitem")
def src_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-column file of ordered pairs."""
    path = new_folder(spark, "src-truth")
    table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").write.csv(path)
    return records.read_truth(spark, path)


@query("SRC-07_json_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property out of JSON texts, counted."""
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def json_graph(spark: SparkSession, sf_dir: str) -> str:
    """A JSON graph folder: nations as vertices, suppliers as edges."""
    base = new_folder(spark, "src-json-graph")
    n = table(spark, sf_dir, "nation")
    n.select(F.col("n_nationkey").cast("string").alias("id"), F.struct(F.col("n_regionkey").cast("string").alias("srcId"), F.col("n_nationkey").cast("string").alias("recId"), F.col("n_name").alias("name")).alias("data")).write.json(f"{base}/vertices.json")
    s = table(spark, sf_dir, "supplier")
    s.select(F.col("s_nationkey").cast("string").alias("source"), F.pmod("s_suppkey", F.lit(40)).cast("string").alias("target"), F.struct(F.lit(0.5).alias("value")).alias("data")).write.json(f"{base}/edges.json")
    return base


@query("SRC-05_json_graph", "SELECT CAST(s_nationkey AS VARCHAR) AS u, CAST(s_suppkey % 40 AS VARCHAR) AS v, CAST(0.5 AS DOUBLE) AS sim FROM supplier WHERE s_suppkey % 40 < 25")
def srcjson_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON graph folder; edges with an unknown end go."""
    return graphs.read_graph(spark, json_graph(spark, sf_dir))[1]


@query("SRC-06_json_graph_pair", "SELECT CAST(n_nationkey AS VARCHAR) AS iri, n_name AS name FROM nation WHERE n_regionkey IN (0, 1)")
def src_json_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two sources of the JSON graph."""
    e, _ = graphs.read_graph(spark, json_graph(spark, sf_dir), ("0", "1"))
    return e.select("iri", F.element_at("props", "name").alias("name"))


def csv_graph(spark: SparkSession, sf_dir: str) -> str:
    """A CSV graph folder with a metadata file, escaped separators and typed values: parts."""
    base = new_folder(spark, "src-csv-graph")
    p = table(spark, sf_dir, "part")
    p.select("p_type").distinct().select(F.concat(F.lit("v;"), "p_type", F.lit(";gtId:int,name:string,price:double"))).write.text(f"{base}/metadata.csv")
    name = F.regexp_replace(F.concat("p_name", F.lit(";x|y")), r"([;|])", r"\\$1")
    p.select(F.concat_ws(";", F.col("p_partkey").cast("string"), F.lit("l"), "p_type", F.concat_ws("|", F.col("p_size").cast("string"), name, F.col("p_retailprice").cast("string")))).write.text(f"{base}/vertices.csv")
    p.select(F.concat_ws(";", F.lit("e"), F.lit("l"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.lit(""), F.lit("0.5"))).write.text(f"{base}/edges.csv")
    return base


@query("SRC-09_csv_graph", "SELECT CAST(p_partkey AS VARCHAR) AS iri, p_type AS source, CAST(p_size AS VARCHAR) AS rec_id, p_name || ';x|y' AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def src_csv_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a CSV graph folder."""
    e, _ = graphs.read_graph(spark, csv_graph(spark, sf_dir))
    return e.select("iri", "source", "rec_id", F.element_at("props", "name").alias("name"), F.element_at("props", "gtId").alias("size"))


@query("SRC-14_url_domain", "SELECT regexp_extract(url, 'https?://[^/?]+') AS source, count(*) AS n FROM pages WHERE regexp_matches(url, 'https?://[^/?]+[/?]') GROUP BY 1")
def src_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per scheme and host."""
    return table(spark, sf_dir, "pages").select(url_domain(F.col("url")).alias("source")).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))


@query("SRC-14_offers", "SELECT regexp_extract(url, 'https?://[^/?]+') AS source, page_id || ' ' || url AS rec_id, 'page ' || page_id AS name FROM pages WHERE page_id % 2 = 0 AND regexp_matches(url, 'https?://[^/?]+[/?]')")
def src_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that occur in a label file."""
    base, p = new_folder(spark, "src-offers"), table(spark, sf_dir, "pages")
    p.select(F.col("page_id").cast("string").alias("nodeID"), "url", F.array(F.create_map(F.lit("/name"), F.concat(F.lit("[page-"), F.col("page_id").cast("string"), F.lit(", other]"))), F.create_map(F.lit("/brand"), F.lit("[null]"))).alias("schema.org_properties")).write.option("compression", "gzip").json(f"{base}/offers.json")
    rec = F.concat_ws(" ", F.col("page_id").cast("string"), "url")
    p.where("page_id % 2 = 0").select(F.concat_ws("#####", rec, rec, F.lit("1"))).write.text(f"{base}/labels.txt")
    o = offers.read_offers(spark, f"{base}/offers.json", offers.read_labels(spark, f"{base}/labels.txt"))
    return o.select("source", "rec_id", F.element_at("props", "name").alias("name"))


@query("SRC-15_labels", "SELECT least(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS lo, greatest(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS hi, o_orderstatus = 'F' AS label FROM orders")
def src_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file with the ``#####`` delimiter."""
    path = new_folder(spark, "src-labels")
    table(spark, sf_dir, "orders").select(F.concat_ws("#####", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"))).write.text(path)
    return offers.read_labels(spark, path)


@query("SRC-17_feature_files", "SELECT p_brand AS src_a, 'x' AS src_b, CAST(p_partkey AS VARCHAR) AS id_a, CAST(p_size AS VARCHAR) AS id_b, p_size > 25 AS label, CAST(p_retailprice AS DOUBLE) AS f0, CAST(p_size AS DOUBLE) AS f1 FROM part")
def src_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature file per source pair: files are moved to their names after writing."""
    base = new_folder(spark, "src-features")
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("source_id"), F.col("p_size").alias("target_id"), F.lit("m").alias("extra"), (F.col("p_size") > 25).alias("label"), F.col("p_retailprice").alias("f0"), F.col("p_size").alias("f1"))
    p.repartition("p_brand").write.option("header", True).partitionBy("p_brand").csv(f"{base}/raw")
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(f"{base}/files"))
    for d in fs.listStatus(fs_path(f"{base}/raw")):  # one folder per source pair
        if "=" in d.getPath().getName():
            part = next(f for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part.getPath(), fs_path(f"{base}/files/{d.getPath().getName().split('=')[1].replace('%23', '#')}_x.csv"))
    f = features.read_feature_files(spark, f"{base}/files")
    return f.select("src_a", "src_b", "id_a", "id_b", "label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("SRC-18_pair_labels", "SELECT 'train' AS part, CAST(p_partkey AS VARCHAR) AS id_a, CAST(p_size AS VARCHAR) AS id_b, p_size > 25 AS label, p_size > 20 AS unsup_label FROM part UNION ALL SELECT 'test', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), s_acctbal > 0, NULL FROM supplier")
def src_pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test pair files."""
    base = new_folder(spark, "src-pair-labels")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_size").alias("target_id"), (F.col("p_size") > 25).alias("label"), (F.col("p_size") > 20).alias("unsupervised_label")).write.option("header", True).csv(f"{base}/train")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("target_id"), (F.col("s_acctbal") > 0).alias("label")).write.option("header", True).csv(f"{base}/test")
    return features.read_pair_labels(spark, f"{base}/train", f"{base}/test")


@query("SRC-19_task_files", "SELECT a.p_type AS src_a, b.p_type AS src_b, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type < b.p_type GROUP BY ALL")
def src_task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written by source pair, and read back across sources only."""
    path = new_folder(spark, "task-files")
    f = part_features(spark, sf_dir)
    features.write_tasks(f.withColumns({"id_a": F.col("id_a").cast("string"), "id_b": F.col("id_b").cast("string")}), path)
    return features.read_tasks(spark, path, across_only=True).groupBy("src_a", "src_b").agg(F.count("*").alias("n"))


@query("SRC-21_prepared_numbers", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size FROM part")
def src_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``/`` to null, numbers coerced, sparse columns gone."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "/").otherwise(F.col("p_size").cast("string")).alias("size"), F.lit("/").alias("empty"))
    return scores.drop_sparse(scores.to_numbers(p, ["size", "empty"]))


@query("PRJ-02_pivot", "SELECT p_type AS source, CAST(p_partkey AS VARCHAR) AS rec_id, p_name AS name, '' AS colour FROM part")
def prj_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns out of property maps; absent ones are empty."""
    e = table(spark, sf_dir, "part").select(F.col("p_type").alias("source"), F.col("p_partkey").cast("string").alias("rec_id"), F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand").alias("props"))
    return records.pivot_sources(e, ["name", "colour"])


@query("PRJ-15_ensure_columns", "SELECT r_regionkey, r_name, '/' AS extra FROM region")
def prj_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing column, filled."""
    return scores.ensure_columns(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_name", "extra"])


@query("PRJ-16_remove_members", "SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1)")
def prj_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster members without some: an anti join."""
    p = table(spark, sf_dir, "part")
    return p.join(p.where("p_size = 1").select("p_name").distinct(), "p_name", "left_anti").select("p_partkey")


@query("PRJ-17_matching_task", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000))")
def prj_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that occur in the gold pairs of a task: two semi joins."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    gold = table(spark, sf_dir, "lineitem").join(s, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(gold, "p_partkey", "left_semi").select("p_partkey")


@query("SNK-03_csv_round_trip", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV, appended to, and counted from its files."""
    path = new_folder(spark, "snk-csv")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    features.write_table(e.where("event_id % 2 = 0"), path)
    features.write_table(e.where("event_id % 2 = 1"), path, append=True)
    return spark.read.option("header", True).csv(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SNK-08_rows_per_file", "SELECT CAST(count(*) AS BIGINT) AS n FROM region")
def snk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the files of a folder."""
    path = new_folder(spark, "snk-rows")
    table(spark, sf_dir, "region").coalesce(1).write.option("header", True).csv(path)
    return features.rows_per_file(spark, path).select("n")
