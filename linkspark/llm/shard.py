"""Sharding: a Feistel permutation with cycle walking over global row numbers.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import random
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.plans.staging import stage

#: Modulus of the round function: the square of a residue stays below 2**62.
PRIME = 2147483647
ROUNDS = 6
#: Buckets of the global order. Bucket totals are the only table that is
#: broadcast; they hold at most BUCKETS rows at every input size.
BUCKETS = 4096
#: Passes of the cycle walk. At most 2 * sqrt(n) + 1 points of the domain lie
#: outside [0, n), so up to n = 900 no walk can be longer, and beyond that a
#: longer one has a chance below n * (2 / sqrt(n)) ** WALK. It raises, never drops.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Addend and multiplier of each round, drawn from ``seed``."""
    rnd = random.Random(seed)
    return [(rnd.randrange(1, PRIME), rnd.randrange(1, PRIME)) for _ in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """Factors of the near-square domain a * b >= n."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _pass(x: Column, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    """One pass over [0, a * b). Even rounds add F(right) to the left half modulo a, odd ones F(left) to the right half modulo b."""
    r = F.pmod(x, F.lit(b))
    halves = F.struct(((x - r) / b).cast("long").alias("l"), r.cast("long").alias("r"))
    rounds = F.array(*(F.struct(F.lit(i % 2).alias("i"), F.lit(add).cast("long").alias("add"), F.lit(mul).cast("long").alias("mul")) for i, (add, mul) in enumerate(keys)))

    def step(h: Column, k: Column) -> Column:
        even = k["i"] == 0
        t = F.pmod(F.pmod(F.when(even, h["r"]).otherwise(h["l"]) + k["add"], F.lit(PRIME)) * k["mul"], F.lit(PRIME))
        f = F.pmod(t * t, F.lit(PRIME))
        return F.struct(F.when(even, F.pmod(h["l"] + f, F.lit(a))).otherwise(h["l"]).cast("long").alias("l"), F.when(even, h["r"]).otherwise(F.pmod(h["r"] + f, F.lit(b))).cast("long").alias("r"))

    return F.aggregate(rounds, halves, step, lambda h: h["l"] * b + h["r"])


def permute(x: Column, n: int, seed: int) -> Column:
    """The image of row number ``x`` under the permutation of [0, n) that ``seed`` picks."""
    (a, b), keys = sides(n), round_keys(seed)
    first = _pass(x, a, b, keys)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < n, y).otherwise(_pass(y, a, b, keys)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Gapless ``rn`` from 0 in the order (bucket, id, crc, size), and the row count.

    The bucket mixes id and text checksum, so neither one hot id nor one hot
    text fills a bucket; wholly equal rows are counted first and expanded last.
    No window spans more than one bucket.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    mixed = F.pmod(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(PRIME)) * 40503 + F.col("text_crc32")
    kinds = stage(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(mixed, F.lit(BUCKETS)).cast("int")), "shard-rows")
    totals = kinds.groupBy("bucket").agg(F.sum("n").alias("rows"))
    n = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = totals.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("start"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = kinds.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(F.broadcast(starts), "bucket").withColumn("from", F.col("start") + F.col("end") - F.col("n"))
    one = F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)).alias("rn")
    return ranked.select("doc_id", "size", "text_crc32", one), n


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows to ``shards`` shards whose row counts differ by one at most.

    ``rn`` is a row's global number, ``place = permute(rn)``; the shard is
    ``place % shards`` and the slot ``place div shards``, so both can be
    computed for any row number without a table. Null texts count as empty
    (size 1); null ids are numbered first in their bucket; repeated rows take
    a place each; an empty table gives no rows. Other columns are not read.
    """
    rows, n = number_rows(docs, id_col, text_col)
    placed = rows.withColumn("place", permute(F.col("rn"), n, seed))
    shard_no = F.pmod("place", F.lit(shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard_no.cast("int").alias("shard"), ((F.col("place") - shard_no) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "rn")
