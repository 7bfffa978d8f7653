"""The opN_ queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import decontam, edits, exact, near, oracle, ordinal, pack, pii, shard, toxic, warc


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by a Feistel permutation of their global row numbers."""
    return shard.shard(_table(spark, sf_dir, "documents"), 8).drop("rn")


def op2_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a replacement, a deletion and an insertion."""
    docs = _table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    third, two = F.floor(n / 3), F.floor(2 * n / 3)
    made = ((third, third + 12, "an edited passage "), (two, two + 7, ""), (n, n, " and one more sentence."))
    script = F.array(*(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("new")) for a, b, new in made))
    return edits.count_edited(docs.withColumn("edits", script), vocabulary("byte_bpe_50k.tiktoken"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equal texts."""
    return exact.dedup(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by byte range."""
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity by a classifier learnt from positive and unlabelled texts."""
    return toxic.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its best alignment to a benchmark item."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and the chances of each higher grade."""
    return ordinal.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's result."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data and the terms that disclose it."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def sanitised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced and disclosing terms generalised or removed; the texts by their MD5."""
    docs = pii.sanitise(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_feistel_shards, op2_icws_near_dedup, op3_edit_token_counts, op4_exact_dedup, op5_warc, op6_nnpu_toxicity, op7_best_fit_packing, op8_decontamination, op9_ordinal_quality, op10_personal_data, sanitised_documents, pipeline)}
ORACLES: dict[str, str] = {"op1_feistel_shards": oracle.shards(), "op4_exact_dedup": oracle.EXACT, "op5_warc": oracle.WARC}
