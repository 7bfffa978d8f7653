"""Property graphs as JSON lines or as CSV with a metadata file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.graph import existing_ends

ENTITIES = "(iri, source, rec_id, props)"


def read_json_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``(iri, source, rec_id, props)``: ``id``, ``data.srcId``, ``data.recId`` and the rest of ``data`` as strings."""
    raw = spark.read.schema("id string, data map<string,string>").json(path)
    return raw.select(F.col("id").alias("iri"), F.element_at("data", "srcId").alias("source"), F.try_element_at("data", F.lit("recId")).alias("rec_id"), F.map_filter("data", lambda k, _: k != "srcId").alias("props"))


def read_json_edges(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """``(u, v, sim)`` of edges whose ends are known."""
    raw = spark.read.schema("source string, target string, data struct<value:double>").json(path)
    return existing_ends(raw.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("data.value").alias("sim")), entities)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(source, at, name, type)`` of lines ``v;source;name:type,name:type``."""
    row = F.split("value", ";")
    lines = spark.read.text(path).where(row[0] == "v").select(row[1].alias("source"), F.posexplode(F.split(row[2], ",")).alias("at", "item"))
    part = F.split("item", ":")
    return lines.select("source", "at", F.trim(part[0]).alias("name"), F.trim(part[1]).alias("type"))


def read_csv_vertices(spark: SparkSession, path: str, metadata: DataFrame, key: str = "gtId") -> DataFrame:
    """``(iri, source, rec_id, props)``; fields split at unescaped ``;`` and ``|``, numbers normalised by declared type, ``rec_id`` from ``key``.

    The metadata table (a row per attribute and source) is broadcast after a count.
    """
    from linkspark.plans.staging import broadcast_if_small

    row = F.split("value", r"(?<!\\);")
    lines = spark.read.text(path).select(F.regexp_replace("value", "[\r\n]+$", "").alias("value")).where(F.size(row) > 3)
    each = lines.select(row[0].alias("iri"), row[2].alias("source"), F.posexplode(F.split(row[3], r"(?<!\\)\|")).alias("at", "raw"))
    typed = each.join(broadcast_if_small(metadata, 200), ["source", "at"])
    value = F.when(F.col("raw") == "", "").when(F.col("type") == "int", F.col("raw").try_cast("long").cast("string")).when(F.col("type").isin("float", "double"), F.col("raw").try_cast("double").cast("string")).otherwise(F.regexp_replace("raw", r"\\([;|])", "$1"))
    props = F.map_from_entries(F.collect_list(F.struct("name", value.alias("v"))))  # one record's attributes
    return typed.groupBy("iri", "source").agg(props.alias("props")).select("iri", "source", F.try_element_at("props", F.lit(key)).alias("rec_id"), "props")


def read_csv_edges(spark: SparkSession, path: str, entities: DataFrame) -> DataFrame:
    """``(u, v, sim)`` from columns 2, 3 and 5; both ends must be known."""
    raw = spark.read.option("sep", ";").schema("c0 string, c1 string, u string, v string, c4 string, sim double").csv(path)
    return existing_ends(raw.select("u", "v", "sim"), entities)


def of_sources(entities: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Entities of two sources; the filter reaches the scan."""
    return entities.where(F.col("source").isin(*pair))


def read_graph(spark: SparkSession, folder: str, pair: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of a folder in either format, told apart by its file names; optionally of two sources."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(fs_path)), reverse=True)

    def named(word: str) -> str:
        return f"{folder}/{next(n for n in names if word in n.lower())}"

    if names and "json" in names[0]:
        entities = read_json_vertices(spark, named("vert"))
        entities = entities if pair is None else of_sources(entities, pair)
        return entities, read_json_edges(spark, named("edge"), entities)
    entities = read_csv_vertices(spark, named("vert"), read_metadata(spark, named("meta")))
    entities = entities if pair is None else of_sources(entities, pair)
    return entities, read_csv_edges(spark, named("edge"), entities)
