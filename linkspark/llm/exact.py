"""Exact deduplication against immutable snapshots behind static binary-fuse filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.plans.staging import broadcast_if_small, stage

#: Distinct digests per filter bucket aimed at; a bucket's filter is built in one task.
BUCKET_KEYS = 200_000
ARITY = 3


def normalised(text: Column) -> Column:
    """The compared text: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- the filter ------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and segment count for ``n`` keys."""
    length = 1 << min(18, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // length) - (ARITY - 1))
    return length, count


def _slots(h: np.ndarray, length: int, count: int) -> list[np.ndarray]:
    """Three positions in neighbouring segments, and never the same one."""
    first = (((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(length - 1)
    inner = (h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36) ^ h << np.uint64(7)) & mask)
    return [(first + j) * length + x.astype(np.int64) for j, x in enumerate(inner)]


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """A binary-fuse filter of distinct uint64 ``keys``: seed, segment length, segment count, 16-bit table.

    Keys are peeled in rounds: all slots held by one key alone give up their
    key at once. A seed that does not peel is replaced by the next.
    """
    n = len(keys)
    length, count = _shape(n)
    for attempt in range(1, 200):
        if attempt % 20 == 0:
            count += max(1, count // 10)
        seed = attempt * 0x9E3779B97F4A7C15 & (2**64 - 1)
        h = _mix(keys, seed)
        at = np.stack(_slots(h, length, count)) if n else np.zeros((ARITY, 0), np.int64)
        size = (count + ARITY - 1) * length
        degree = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in at:
            np.add.at(held, row, np.arange(n)) if n < 64 else held.__iadd__(np.bincount(row, weights=np.arange(n, dtype=np.float64), minlength=size).astype(np.int64))
        order, left = [], n
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            keys_now, first = np.unique(held[alone], return_index=True)
            order.append((keys_now, alone[first]))
            for row in at:
                np.subtract.at(degree, row[keys_now], 1)
                np.subtract.at(held, row[keys_now], keys_now)
            left -= len(keys_now)
        if left:
            continue
        table, prints = np.zeros(size, np.uint16), _fingerprint(h)
        for keys_now, slot in reversed(order):
            table[slot] = 0
            table[slot] = prints[keys_now] ^ table[at[0][keys_now]] ^ table[at[1][keys_now]] ^ table[at[2][keys_now]]
        return seed, length, count, table
    raise RuntimeError("no seed peels; are the keys distinct?")


def probe_filter(keys: np.ndarray, seed: int, length: int, count: int, table: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for a key that is."""
    h = _mix(keys, seed)
    a, b, c = _slots(h, length, count)
    return (table[a] ^ table[b] ^ table[c]) == _fingerprint(h)


# --- the operator ----------------------------------------------------------

FILTER_SCHEMA = "bucket int, seed string, seg_length int, seg_count int, bits binary"


def _keys(pdf: pd.DataFrame) -> np.ndarray:
    return np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64))


def _filter_of(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, length, count, table = build_filter(_keys(pdf))
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "seed": [str(seed)], "seg_length": [length], "seg_count": [count], "bits": [table.tobytes()]})


def snapshot_filters(groups: DataFrame) -> DataFrame:
    """One static filter per bucket of an immutable snapshot's distinct digests (columns ``key``, ``bucket``)."""
    return groups.select("bucket", "key").groupBy("bucket").applyInPandas(_filter_of, FILTER_SCHEMA)


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(batch), bool)
    if len(batch) and len(filters):
        f = filters.iloc[0]
        hit = probe_filter(batch["key"].to_numpy(np.int64).view(np.uint64), int(f["seed"]), int(f["seg_length"]), int(f["seg_count"]), np.frombuffer(f["bits"], np.uint16))
    return batch[hit]


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """The batch digests that a snapshot's filters let through: all that the snapshot holds, and about one in 65,536 others."""
    return groups.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, groups.schema)


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, sha, in_batch, rid)`` per row: the one full read of the texts.

    ``in_batch`` splits the rows by a hash of the id into an old snapshot and
    an incoming batch; ``rid`` numbers the rows and is fixed once staged.
    """
    doc_id = F.col(id_col).cast("long")
    sha = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    return docs.select(doc_id.alias("doc_id"), sha.alias("sha"), (F.pmod(F.xxhash64(doc_id), F.lit(2)) == 1).alias("in_batch"), F.monotonically_increasing_id().alias("rid"))


def _best() -> Column:
    """The row that stays: largest id, nulls last, then the first row."""
    return F.max(F.struct("doc_id", (-F.col("rid")).alias("back"))).alias("top")


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per digest: copies collapse map-side before anything is compared."""
    g = rows.groupBy("digest").agg(_best(), F.count("*").alias("n"))
    return g.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    The rows form an immutable snapshot and an incoming batch. Batch digests
    are grouped among themselves; those that pass the snapshot's binary-fuse
    filters join the snapshot's exact groups. The texts of every group of more
    than one row are then compared byte by byte, by grouping on the text
    itself, and a digest shared by different texts is split by text.
    ``digest_bytes`` below 32 exists for tests of that split.

    Null texts equal empty ones. The largest id of a group stays; null ids
    lose against any other, and ``keep_id`` is null where a group has no
    other. Of rows that repeat the largest id the first is ``kept``. Other
    columns are not read. An empty table gives no rows.
    """
    digest = F.substring("sha", 1, digest_bytes)
    rows = stage(fingerprint_rows(docs, id_col, text_col), "exact-rows").withColumn("digest", digest)
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    old, new = (stage(_grouped(rows.where(c), buckets), "exact-groups") for c in ("not in_batch", "in_batch"))
    filters = stage(snapshot_filters(old), "exact-filters")
    positive = screen(new.select("digest", "key", "bucket"), filters).select("digest")
    pairs = new.join(positive, "digest", "left_semi").select("digest", F.col("top").alias("new_top"), F.col("n").alias("new_n")).join(old.select("digest", "top", "n"), "digest")
    met = stage(pairs.select("digest", F.greatest("top", "new_top").alias("top"), (F.col("n") + F.col("new_n")).alias("n")), "exact-met")
    inside = old.where("n > 1").unionByName(new.where("n > 1")).select("digest", "top", "n").join(met.select("digest"), "digest", "left_anti")
    several = stage(met.unionByName(inside), "exact-several")
    # byte check: only rows under these digests move, and copies combine map-side
    norm = normalised(F.col(text_col))
    texts = docs.select(norm.alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).withColumn("digest", digest)
    texts = texts.join(broadcast_if_small(several.select("digest"), 64), "digest", "left_semi")
    checked = stage(texts.groupBy("digest", "sha", "norm").agg(F.count("*").alias("n")).drop("norm"), "exact-checked")
    split = checked.groupBy("digest").agg(F.count("*").alias("texts"), F.countDistinct("sha").alias("shas")).where("texts > 1")
    if not split.where("texts > shas").isEmpty():
        raise ValueError("different texts with one SHA-256: raise digest strength before deduplicating")
    whole = several.join(checked.select("digest", "sha"), "digest").join(split, "digest", "left_anti").select("sha", "top", "n")
    parts = rows.join(split.select("digest"), "digest", "left_semi").groupBy("sha").agg(_best(), F.count("*").alias("n"))
    out = rows.join(whole.unionByName(parts), "sha", "left")
    alone = F.col("n").isNull()
    kept = alone | (F.col("rid") == -F.col("top.back"))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
