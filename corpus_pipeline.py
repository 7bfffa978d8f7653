"""A corpus pipeline of five stages, each over all that the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read as the next one's
``docs``. All but the last return the columns of ``documents``, whatever they
are called.

Null texts count as empty; empty texts equal each other and hold no benchmark
item. Very long texts are read whole. Rows that repeat an id, or have none,
are decided on one by one; of equal or near-equal rows the one of the largest
id stays, null being the least. Without labels nothing is rejected, without
benchmark items nothing is dropped, and empty tables pass through as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import decontam, exact, near, pack, toxic
from linkspark.llm.queries import vocabulary
from linkspark.plans.staging import broadcast_if_small, new_folder, scratch, stage


def _without(docs: DataFrame, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose ids ``dropped(docs)`` returns.

    Decisions are made by row. Where ids repeat or are null, rows get numbers
    in the order of their ids instead (null first), and their ids back after.
    The dropped ids are broadcast only if their counted size allows it.
    """
    columns, own = docs.columns, "own_id"
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows > ids:
        while own in columns:
            own += "_"
        docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn(own, F.col("doc_id"))
        docs = stage(docs.withColumn("doc_id", F.monotonically_increasing_id()), "pipeline-rows")
    gone = stage(dropped(docs).select("doc_id"), "pipeline-dropped")
    left = docs.join(broadcast_if_small(gone, 24), "doc_id", "left_anti")
    return left.select(*columns) if rows <= ids else left.withColumn("doc_id", F.col(own)).select(*columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not predict to be toxic; scores come from the text alone."""
    return toxic.reject(docs, toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one of the largest id."""
    return _without(docs, lambda d: exact.dedup(d).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, the one of the largest id."""
    return _without(docs, lambda d: near.near_duplicates(d).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda d: decontam.contamination(d, items).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining rows in sequences of at most 4096 tokens."""
    return pack.pack(docs, vocabulary("word_bpe_49k.json"), 4096)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Learnt and approximate stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; its intermediates are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        out = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark):
            stage_of(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
