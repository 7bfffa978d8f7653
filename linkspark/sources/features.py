"""Feature files per source pair, train and test pair files, and files of linkage tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feature_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(src_a, src_b, id_a, id_b, label, features)`` of files ``<s>_<t>.csv``; features start at the fifth column."""
    raw = spark.read.option("header", True).csv(folder)
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # the name comes percent-encoded
    name = F.regexp_extract(file, r"^(.*)\.csv(\.gz)?$", 1)
    part = F.split(name, "_")
    return raw.select(part[0].alias("src_a"), part[1].alias("src_b"), F.col("source_id").alias("id_a"), F.col("target_id").alias("id_b"), F.lower("label").isin("true", "1", "1.0").alias("label"), F.array(*(F.col(f"`{c}`").try_cast("double") for c in raw.columns[4:])).alias("features"))


def read_pair_labels(spark: SparkSession, train: str, test: str) -> DataFrame:
    """``(part, id_a, id_b, label, unsup_label)``; test pairs have no unsupervised label."""

    def flag(c: str):
        return F.lower(F.trim(c)).isin("true", "1", "1.0")

    a, b = spark.read.option("header", True).csv(train), spark.read.option("header", True).csv(test)
    left = a.select(F.lit("train").alias("part"), F.col("source_id").alias("id_a"), F.col("target_id").alias("id_b"), flag("label").alias("label"), flag("unsupervised_label").alias("unsup_label"))
    return left.unionByName(b.select(F.lit("test").alias("part"), F.col("source_id").alias("id_a"), F.col("target_id").alias("id_b"), flag("label").alias("label"), F.lit(None).cast("boolean").alias("unsup_label")))


def write_tasks(pairs: DataFrame, folder: str) -> None:
    """Write pairs by source pair; an empty task is one without rows."""
    pairs.write.mode("overwrite").partitionBy("src_a", "src_b").parquet(folder)


def read_tasks(spark: SparkSession, folder: str, across_only: bool = False) -> DataFrame:
    """Read linkage tasks; ``across_only`` leaves out tasks inside one source, which prunes their folders."""
    pairs = spark.read.option("basePath", folder).schema("id_a string, id_b string, features array<double>, src_a string, src_b string").parquet(folder)
    return pairs.where("src_a <> src_b") if across_only else pairs


def write_table(df: DataFrame, path: str, kind: str = "csv", append: bool = False) -> None:
    """Results, test tables and logs as CSV with header, or Parquet."""
    w = df.write.mode("append" if append else "overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def append_result(spark: SparkSession, path: str, row: dict) -> None:
    """Append one row of an experiment's result."""
    write_table(spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1), path, append=True)


def rows_per_file(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, n)`` of a folder of CSV files with header."""
    return spark.read.option("header", True).csv(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def pair_id_features(pairs: DataFrame, gold: DataFrame, sep: str = "|") -> DataFrame:
    """The active-learning frame: ``pair_id, u, v, datasource_pair, features, agg_score, label``."""
    from linkspark.operators.scores import mean_present

    lo, hi = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    rows = pairs.select(F.concat_ws(sep, "id_a", "id_b").alias("pair_id"), F.col("id_a").alias("u"), F.col("id_b").alias("v"), F.concat_ws(sep, "src_a", "src_b").alias("datasource_pair"), "features", mean_present(F.col("features")).alias("agg_score"), lo.alias("lo"), hi.alias("hi"))
    return rows.join(gold.select("lo", "hi").distinct().withColumn("label", F.lit(True)), ["lo", "hi"], "left").withColumn("label", F.coalesce("label", F.lit(False))).drop("lo", "hi")


def without_sentinel(pairs: DataFrame) -> DataFrame:
    """Features with -1 as 0."""
    return pairs.withColumn("features", F.transform("features", lambda x: F.when(x == -1, 0.0).otherwise(x)))


def rescaled_features(pairs: DataFrame, reverse: list[int] = ()) -> DataFrame:
    """Each feature min-max scaled over all rows, -1 left out and kept, distances (``reverse``) turned into similarities."""
    long = pairs.select(F.posexplode("features").alias("f", "x")).where("x <> -1").groupBy("f").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = F.broadcast(long.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("low", "high")))).alias("ends__")))  # an entry per feature

    def scale(x, i):
        e = F.try_element_at("ends__", i)
        s = F.coalesce(F.try_divide(x - e["low"], e["high"] - e["low"]), F.lit(0.0))
        return F.when(x == -1, -1.0).when(F.array_contains(F.array(*(F.lit(r) for r in reverse)).cast("array<int>"), i), 1 - s).otherwise(s)

    return pairs.crossJoin(ends).withColumn("features", F.transform("features", scale)).drop("ends__")


def read_embeddings(spark: SparkSession, path: str, token: str = "token", vector: str = "vector") -> DataFrame:
    """A Parquet dictionary of word vectors."""
    return spark.read.parquet(path).select(F.col(token).alias("token"), F.col(vector).cast("array<double>").alias("vector"))


def mean_embedding(records: DataFrame, id_col: str, tokens, dictionary: DataFrame) -> DataFrame:
    """``(id, vector)``: mean vector of a record's distinct known tokens."""
    words = records.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens)).alias("token"))
    each = words.join(dictionary, "token").select("id", F.posexplode("vector").alias("k", "x")).groupBy("id", "k").agg(F.avg("x").alias("m"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("vector"))


def embedding_similarity(rows: DataFrame, a: str, b: str, dictionary: DataFrame, out: str = "similarity") -> DataFrame:
    """``rows`` with the cosine of the vectors of two texts, blanks stripped; 0 if either is not in the dictionary."""
    from linkspark.functions.similarity import cosine

    def with_vector(df: DataFrame, c: str, name: str) -> DataFrame:
        words = dictionary.select(F.col("token").alias("token__"), F.col("vector").alias(name))
        return df.join(words, F.replace(df[c], F.lit(" "), F.lit("")) == F.col("token__"), "left").drop("token__")

    both = with_vector(with_vector(rows, a, "x__"), b, "y__")
    return both.withColumn(out, F.coalesce(cosine(F.col("x__"), F.col("y__")), F.lit(0.0))).drop("x__", "y__")
