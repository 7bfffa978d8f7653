"""Blocking and candidate pairs: one equi-join on computed keys instead of a loop over source pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions.registry import ComparisonSpec
from linkspark.plans.staging import BROADCAST_BYTES, stage

#: Ids in one array of ``valued_pairs``; two arrays make at most its square of rows at a time.
CHUNK = 32


def with_keys(records: DataFrame, keys: Column) -> DataFrame:
    """One row per record and blocking key; ``keys`` is a string or, for disjunctive blocking, an array. Empty keys block nothing."""
    kind = records.select(keys.alias("k")).schema["k"].dataType.typeName()
    keyed = records.withColumn("bkv", F.explode(keys) if kind == "array" else keys)
    return keyed.where("bkv is not null and bkv <> ''")


def block_statistics(keyed: DataFrame) -> DataFrame:
    """Number of blocks, and least, mean and largest size."""
    sizes = keyed.groupBy("bkv").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("blocks"), F.min("n").alias("min_size"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"))


def largest_blocks(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``(key, max_size)``: the largest block of each candidate key, in one pass."""
    long = records.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), c.cast("string").alias("bkv")) for n, c in keys.items()))).alias("k")).select("k.*")
    return long.where("bkv is not null").groupBy("key", "bkv").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("max_size"))


def candidates(keyed: DataFrame, source: str = "source", rec: str = "rec_id", intra: bool = False, salts: int = 1, single: bool = False) -> DataFrame:
    """``(src_a, src_b, id_a, id_b)`` of records that share a key, once each.

    Sources come in order; with ``intra`` also pairs inside a source, by
    ascending id. ``salts`` above 1 splits every key's left side, so that a
    block that holds much of the data is joined by several tasks. With
    ``single`` each record is known to have one key and one row, so no pair
    can repeat and the pairs are not shuffled again.
    """
    light = keyed.select(F.col(source).alias("s"), F.col(rec).alias("r"), "bkv")
    left, right = light.select(F.col("s").alias("src_a"), F.col("r").alias("id_a"), "bkv"), light.select(F.col("s").alias("src_b"), F.col("r").alias("id_b"), "bkv")
    on = ["bkv"]
    if salts > 1:
        left = left.withColumn("salt", F.pmod(F.xxhash64("id_a"), F.lit(salts)))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        on.append("salt")
    keep = F.col("src_a") < F.col("src_b")
    if intra:
        keep = keep | ((F.col("src_a") == F.col("src_b")) & (F.col("id_a") < F.col("id_b")))
    found = left.join(right, on).where(keep).select("src_a", "src_b", "id_a", "id_b")
    return found if single else found.distinct()


def task_counts(keyed: DataFrame, source: str = "source") -> DataFrame:
    """``(src_a, src_b, n)``: how many pairs ``candidates(single=True)`` gives each pair of sources, by the rows per block and source; no pair is made."""
    held = keyed.groupBy("bkv", F.col(source).alias("s")).agg(F.count("*").alias("n"))
    a, b = (held.select("bkv", F.col("s").alias(f"src_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, "bkv").where("src_a < src_b").groupBy("src_a", "src_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))


def covering(keyed: DataFrame, source: str = "source", rec: str = "rec_id") -> DataFrame:
    """``(src_a, src_b, id_a, id_b)``: each record with one record of every other source of its block.

    A part of ``candidates`` with all its tasks and, in each task, all its
    records: enough where only it matters which records are in a task.
    """
    light = keyed.select(F.col(source).alias("s"), F.col(rec).alias("r"), "bkv")
    one = light.groupBy("bkv", F.col("s").alias("s_")).agg(F.min("r").alias("r_"))
    met = light.join(one, "bkv").where("s <> s_")
    first = F.col("s") < F.col("s_")
    return met.select(F.least("s", "s_").alias("src_a"), F.greatest("s", "s_").alias("src_b"), F.when(first, F.col("r")).otherwise(F.col("r_")).alias("id_a"), F.when(first, F.col("r_")).otherwise(F.col("r")).alias("id_b"))


def _tasks(keyed: DataFrame, salts: int) -> int:
    """Partitions of ``meet``."""
    spark = keyed.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * salts * spark.sparkContext.defaultParallelism)


def meet(keyed: DataFrame, columns: list[str], source: str = "source", rec: str = "rec_id", salts: int = 1) -> DataFrame:
    """``(src_a, src_b, task, id_a, id_b)`` of cross-source pairs for a single key per record, with ``columns`` of both as ``a__`` and ``b__``.

    A record meets each later source of its block, so the join makes no pair
    that is dropped again, and a block is split by its sources and, with
    ``salts`` above 1, by the records of the later one. The number of
    partitions is fixed, as few bytes of records make many pairs.
    """
    parts = _tasks(keyed, salts)
    later = keyed.select("bkv", F.col(source).alias("src_b")).distinct()
    a = keyed.select(F.col(source).alias("src_a"), F.col(rec).alias("id_a"), "bkv", *(F.col(c).alias(f"a__{c}") for c in columns)).join(later, "bkv").where("src_a < src_b").withColumn("task", F.concat_ws("|", "src_a", "src_b"))
    b = keyed.select(F.col(source).alias("src_b"), F.col(rec).alias("id_b"), "bkv", *(F.col(c).alias(f"b__{c}") for c in columns))
    on = ["bkv", "src_b"]
    if salts > 1:
        a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        b = b.withColumn("salt", F.pmod(F.xxhash64("id_b", *(f"b__{c}" for c in columns)), F.lit(salts)))
        on.append("salt")
    a, b = (x.repartition(parts, *on) for x in (a, b))
    return a.join(b.hint("shuffle_hash"), on).drop("bkv", "salt")


def by_value(keyed: DataFrame, column: str, value: Callable[[Column, Column], Column], row_bytes: int = 48) -> tuple[DataFrame, DataFrame, int] | None:
    """What ``value`` gives for a column, computed once per pair of its values: ``(keyed with code, (at, value), n)``.

    A pair of records finds its value at ``a__code * n + b__code``; nulls are
    values. None if the pairs of values are too many to broadcast.
    """
    values = stage(keyed.select(F.col(column).alias("v")).distinct(), "values")
    n = values.count()
    if n * n * row_bytes > BROADCAST_BYTES:
        return None
    codes = values.select("v", (F.row_number().over(Window.orderBy("v")) - 1).cast("long").alias("code"))  # counted above
    coded = keyed.join(F.broadcast(codes), F.col(column).eqNullSafe(F.col("v"))).drop("v")
    a, b = (codes.withColumnsRenamed({"v": f"v_{x}", "code": f"code_{x}"}) for x in "ab")
    both = a.repartition(keyed.sparkSession.sparkContext.defaultParallelism, "code_a").crossJoin(F.broadcast(b))
    return coded, stage(both.select((F.col("code_a") * n + F.col("code_b")).alias("at"), value(F.col("v_a"), F.col("v_b")).alias("value")), "value-pairs"), n


def valued_pairs(keyed: DataFrame, column: str, value: Callable[[Column, Column], Column], source: str = "source", rec: str = "rec_id", salts: int = 4) -> DataFrame:
    """``(id_a, id_b, value)``: all pairs of ``meet`` with what ``value`` gives for a column of both.

    Records alike in block, source and column are gathered in arrays of ids;
    the arrays meet, get their value (looked up if ``by_value`` can be) and
    are unfolded last. The coalesce leaves the partitions as they are, but
    ends the join's generated code, which would copy all pairs of an array
    with its block before the first is passed on.
    """
    once = by_value(keyed, column, value)
    coded, found, n = once or (keyed, None, 0)
    by = "code" if once else column
    place = F.row_number().over(Window.partitionBy("bkv", source, by).orderBy(rec))
    ids = F.transform(F.collect_list(F.struct(F.col(rec).alias("id"))), lambda x: x["id"])  # a list of the ids themselves would leave out nulls
    held = coded.withColumn("no", F.floor((place - 1) / CHUNK)).groupBy("bkv", source, by, "no").agg(ids.alias("ids"))
    met = meet(stage(held, "gathered"), [by, "ids"], source, "no", salts)
    if once:
        met = met.withColumn("at", F.col("a__code") * n + F.col("b__code")).join(F.broadcast(found), "at")
    else:
        met = met.withColumn("value", value(F.col(f"a__{column}"), F.col(f"b__{column}")))
    met = met.select("a__ids", "b__ids", "value").coalesce(_tasks(keyed, salts))
    return met.select("b__ids", "value", F.explode("a__ids").alias("id_a")).select("id_a", F.explode("b__ids").alias("id_b"), "value")


def compare(pairs: DataFrame, records: DataFrame, spec: ComparisonSpec, source: str = "source", rec: str = "rec_id") -> DataFrame:
    """Add ``features`` to candidate pairs; q-gram sets are made once per record, before the joins."""
    made = spec.prepare(records)
    need = [c for c in made.columns if c.removesuffix("__q") in spec.attributes()]
    a = made.select(F.col(source).alias("src_a"), F.col(rec).alias("id_a"), *(F.col(c).alias(f"a__{c}") for c in need))
    b = made.select(F.col(source).alias("src_b"), F.col(rec).alias("id_b"), *(F.col(c).alias(f"b__{c}") for c in need))
    joined = pairs.join(a, ["src_a", "id_a"]).join(b, ["src_b", "id_b"])
    return joined.select("src_a", "src_b", "id_a", "id_b", spec.features(lambda c: F.col(f"a__{c}"), lambda c: F.col(f"b__{c}")).alias("features"))


def block_join(keyed: DataFrame, spec: ComparisonSpec, source: str = "source", rec: str = "rec_id", intra: bool = False) -> DataFrame:
    """Candidates and features in one join, for a single key per record: nothing is made distinct, so nothing else is shuffled."""
    made = spec.prepare(keyed)
    need = [c for c in made.columns if c.removesuffix("__q") in spec.attributes()]
    a = made.select(F.col(source).alias("src_a"), F.col(rec).alias("id_a"), "bkv", *(F.col(c).alias(f"a__{c}") for c in need))
    b = made.select(F.col(source).alias("src_b"), F.col(rec).alias("id_b"), "bkv", *(F.col(c).alias(f"b__{c}") for c in need))
    keep = F.col("src_a") < F.col("src_b")
    if intra:
        keep = keep | ((F.col("src_a") == F.col("src_b")) & (F.col("id_a") < F.col("id_b")))
    return a.join(b, "bkv").where(keep).select("src_a", "src_b", "id_a", "id_b", spec.features(lambda c: F.col(f"a__{c}"), lambda c: F.col(f"b__{c}")).alias("features"))


def no_blocking(records: DataFrame, source: str = "source", rec: str = "rec_id") -> DataFrame:
    """All cross-source pairs; for small tables only, as the feature asks for the whole product."""
    a = records.select(F.col(source).alias("src_a"), F.col(rec).alias("id_a"))
    b = records.select(F.col(source).alias("src_b"), F.col(rec).alias("id_b"))
    return a.crossJoin(b).where("src_a < src_b")


def given_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, rec: str = "rec_id") -> DataFrame:
    """``(lo, hi, id_a, id_b)`` of listed pairs that fit in either orientation; the listed one goes first."""
    p = pairs.select(F.col(pairs.columns[0]).alias("x"), F.col(pairs.columns[1]).alias("y"))
    a, b = left.select(F.col(rec).alias("id_a")).distinct(), right.select(F.col(rec).alias("id_b")).distinct()
    straight = p.join(a, p.x == a.id_a).join(b, p.y == b.id_b)
    turned = p.join(a, p.y == a.id_a).join(b, p.x == b.id_b)
    turned = turned.join(straight.select("x", "y"), ["x", "y"], "left_anti").select("x", "y", "id_a", "id_b")
    both = straight.select("x", "y", "id_a", "id_b").unionByName(turned)
    return both.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "id_a", "id_b").distinct()


def task_pairs(tasks: DataFrame) -> DataFrame:
    """All pairs of linkage tasks that share neither their first nor their second source. There are few tasks, so this is a nested loop over names."""
    a = tasks.select(F.col("src_a").alias("a1"), F.col("src_b").alias("b1"))
    b = tasks.select(F.col("src_a").alias("a2"), F.col("src_b").alias("b2"))
    return a.join(b, (F.col("a1") != F.col("a2")) & (F.col("b1") != F.col("b2")) & (F.struct("a1", "b1") < F.struct("a2", "b2")))


def word_keys(words: Column) -> Column:
    """64-bit keys of a set of words, in one common order: longer words, which are rarer, first."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), F.xxhash64(w).alias("k"))))
    return F.transform(ordered, lambda x: x["k"])


def overlapping(records: DataFrame, least: float, source: str = "source", rec: str = "rec_id", words: str = "words") -> DataFrame:
    """``(id_a, id_b)`` of records of one block and different sources whose word sets may have a Jaccard similarity of ``least``.

    ``records`` has ``source, rec_id, bkv, words``, the last a set in an order
    common to all (see ``word_keys``). Such sets share at least ``least`` of
    the larger one, so they meet within the first n - ceil(least * n) + 1
    words of each. Only ids and words are joined, never whole sets, and a
    block that holds much of the data is split by its words.
    """
    n = F.size(words)
    head = F.slice(words, F.lit(1), (n - F.ceil(n * (least - 1e-9)) + 1).cast("int"))
    heads = records.where(n > 0).select(F.col(source).alias("s"), F.col(rec).alias("id"), "bkv", n.alias("n"), F.explode(head).alias("word"))
    a, b = (heads.select("bkv", "word", *(F.col(c).alias(f"{c}_{x}") for c in ("s", "id", "n"))) for x in "ab")
    met = a.join(b, ["bkv", "word"]).where((F.col("s_a") < F.col("s_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (least - 1e-9)))
    return met.select("id_a", "id_b").distinct()


def nearest(queries: DataFrame, corpus: DataFrame, k: int, distance, id_col: str = "id") -> DataFrame:
    """Exact k nearest rows of ``corpus`` for each query by ``distance(query column, corpus column)``; ties by id.

    The smaller query side is replicated to the partitions of the corpus;
    each partition keeps its k best before anything is shuffled.
    """
    from pyspark.sql import Window

    q = queries.select(F.col(id_col).alias("query"), F.col("vector").alias("qv"))
    c = corpus.select(F.col(id_col).alias("neighbour"), F.col("vector").alias("cv"))
    pairs = q.crossJoin(c).where("query <> neighbour").select("query", "neighbour", distance(F.col("qv"), F.col("cv")).alias("distance"))
    near = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour")))
    return near.where(F.col("rank") <= k)


def pairs_of_vectors(selected: DataFrame, pairs: DataFrame) -> DataFrame:
    """The record pairs behind selected feature arrays."""
    return pairs.join(selected.select("features").distinct(), "features", "left_semi")
