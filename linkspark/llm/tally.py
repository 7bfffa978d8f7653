"""Fixed-size count tables summed over all tasks without an unbounded group."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def chunks_of(counts: np.ndarray) -> list[tuple[int, int, bytes]]:
    """``(task, chunk, compressed counts)`` of the chunks that are not all zero."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    return [(task, i // CHUNK, zlib.compress(counts[i : i + CHUNK].astype(np.int64).tobytes(), 1)) for i in range(0, len(counts), CHUNK) if counts[i : i + CHUNK].any()]


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["counts"])
    return pd.DataFrame({"salt": [int(pdf["salt"].iloc[0])], "chunk": [int(pdf["chunk"].iloc[0])], "counts": [zlib.compress(total.tobytes())]})


def total(tallies: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' tables (columns ``task``, ``chunk``, ``counts``) of ``size`` counters.

    Tasks are added in two levels of about the square root of their number
    each; what reaches the driver is one table, whatever the input.
    """
    tasks = (tallies.agg(F.max("task")).first()[0] or 0) + 1
    schema = "salt int, chunk int, counts binary"
    level = tallies.select(F.pmod("task", F.lit(max(1, int(tasks**0.5)))).cast("int").alias("salt"), "chunk", "counts").groupBy("salt", "chunk").applyInPandas(_add, schema)
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
    for r in level.withColumn("salt", F.lit(0)).groupBy("chunk").applyInPandas(_add, schema).collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] += part
    return out[:size]
