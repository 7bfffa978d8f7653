"""Record and truth CSV files, and columns prepared for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, rec_id: str, attributes: list[str] | None = None, header: bool = True) -> DataFrame:
    """A CSV or CSV.GZ file of strings, trimmed and lower-cased; of repeated ids the last line stays.

    Attributes that are not selected are blanked and keep their place.
    Without a header the columns are ``_c0``, ``_c1`` .. . Missing is ``''``.
    """
    raw = spark.read.option("header", header).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    at = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    keep = set(attributes or raw.columns) | {rec_id}
    rows = raw.select(at.alias("at__"), *(F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c) if c in keep else F.lit("").alias(c) for c in raw.columns))
    last = rows.withColumn("n__", F.row_number().over(Window.partitionBy(rec_id).orderBy(F.desc("at__"))))
    return last.where("n__ = 1").drop("at__", "n__")


def duplicate_ids(spark: SparkSession, path: str, rec_id: str, header: bool = True) -> int:
    """Lines whose id occurred before."""
    raw = spark.read.option("header", header).csv(path)
    row = raw.agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim(rec_id))).alias("d")).first()
    return row["n"] - row["d"]


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(id_a, id_b)`` of a two-column file without header, lower-cased, in the order given."""
    raw = spark.read.schema("id_a string, id_b string").option("mode", "FAILFAST").csv(path)
    return raw.select(F.lower(F.trim("id_a")).alias("id_a"), F.lower(F.trim("id_b")).alias("id_b")).dropDuplicates()


def pivot_sources(entities: DataFrame, attributes: list[str]) -> DataFrame:
    """Named columns out of a ``props`` map; absent attributes are ``''``."""
    return entities.select("source", "rec_id", *(F.coalesce(F.try_element_at("props", F.lit(a)), F.lit("")).alias(a) for a in attributes))


def attribute_names(entities: DataFrame) -> DataFrame:
    """``(source, attribute)`` of all attributes that occur."""
    return entities.select("source", F.explode(F.map_keys("props")).alias("attribute")).distinct()
