"""Product offers as JSON lines, and label files of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions.text import flatten_property, url_domain


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(lo, hi, label)`` of lines ``a#####b#####0|1``."""
    part = F.split("value", "#####")
    raw = spark.read.text(path).where(F.size(part) >= 3).select(F.trim(part[0]).alias("a"), F.trim(part[1]).alias("b"), (F.trim(part[2]).cast("int") == 1).alias("label"))
    return raw.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "label").dropDuplicates()


def read_link_sets(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both label files with their ``part``."""
    return read_labels(spark, train).withColumn("part", F.lit("train")).unionByName(read_labels(spark, test).withColumn("part", F.lit("test")))


def read_offers(spark: SparkSession, path: str, links: DataFrame | None = None) -> DataFrame:
    """``(source, rec_id, props)``: id = node id and url, source = scheme and host; offers without a host, and those in no link, are left out."""
    raw = spark.read.schema("nodeID string, url string, `schema.org_properties` array<map<string,string>>").json(path)
    flat = F.flatten(F.transform("`schema.org_properties`", lambda m: F.map_entries(m)))
    # of repeated properties the last counts
    names = F.array_distinct(F.transform(flat, lambda e: F.replace(e["key"], F.lit("/"), F.lit(""))))
    props = F.map_from_entries(F.transform(names, lambda k: F.struct(k, flatten_property(F.element_at(F.filter(flat, lambda e: F.replace(e["key"], F.lit("/"), F.lit("")) == k), -1)["value"]))))
    offers = raw.select(url_domain(F.col("url")).alias("source"), F.trim(F.concat_ws(" ", "nodeID", "url")).alias("rec_id"), F.coalesce(props, F.create_map().cast("map<string,string>")).alias("props")).where("source is not null")
    if links is None:
        return offers
    ids = links.select(F.explode(F.array("lo", "hi")).alias("rec_id")).distinct()
    return offers.join(ids, "rec_id", "left_semi")


def write_kept_lines(spark: SparkSession, path: str, links: DataFrame, out: str) -> None:
    """The raw lines of offers that occur in links."""
    ids = links.select(F.explode(F.array("lo", "hi")).alias("rec_id")).distinct()
    key = F.trim(F.concat_ws(" ", F.get_json_object("value", "$.nodeID"), F.get_json_object("value", "$.url")))
    spark.read.text(path).withColumn("rec_id", key).join(ids, "rec_id", "left_semi").select("value").write.option("compression", "gzip").text(out)
