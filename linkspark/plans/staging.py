"""Cut lineage through the shared folder that the cluster names.

Every intermediate that is read more than once, or whose recomputation would
not be deterministic, is written as Parquet below ``spark.checkpoint.dir``.
Lost executors then cost a re-read, never a recomputation with other row
numbers.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[str] = []

#: Largest side, in bytes, that is broadcast on purpose. Every use counts the
#: rows first and falls back to a shuffled join beyond this bound.
BROADCAST_BYTES = 48 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temp folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":  # executors of local-cluster have folders of their own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="linkspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    path = f"{shared_root(spark)}/stage-{uuid.uuid4().hex[:12]}-{name}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader over what was written."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what was staged (after the first ``since`` folders); call once the results have been written."""
    jvm, n = spark.sparkContext._jvm, 0
    while len(_STAGED) > since:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        n += bool(fs.delete(path, True))
    return n


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end; results must have been written by then."""
    since = len(_STAGED)
    try:
        yield
    finally:
        release(spark, since)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if its counted size stays below ``limit``, else ``df`` for a shuffled join.

    Meant for staged inputs, so that the count is a metadata read.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
