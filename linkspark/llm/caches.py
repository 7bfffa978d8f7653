"""Memory of Python workers: bounded word caches, one operator's at a time, and small Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession

#: Entries of one cache; a worker's caches stay within some tens of MB.
MOST_WORDS = 200_000
#: Rows of one Arrow batch where a row carries a whole text or its shingles.
BATCH_ROWS = 512

_owner: list[object] = [None]
_all: list[dict] = []


class WordCache(dict):
    """Word to ``fn(word)``; starts afresh when it holds ``most`` words."""

    def __init__(self, fn: Callable[[str], Any], most: int = MOST_WORDS, shared: bool = True) -> None:
        super().__init__()
        self.fn, self.most = fn, most
        if shared:
            _all.append(self)

    def __missing__(self, word: str) -> Any:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.fn(word)
        return value


def claim(owner: str) -> None:
    """Called when a task starts: what other operators cached in this worker is let go."""
    if _owner[0] != owner:
        for cache in _all:
            cache.clear()
        _owner[0] = owner
        _give_back()


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def values(column: Any) -> Iterator[Any]:
    """The values of an Arrow column one at a time, so that a batch of long texts is never held twice."""
    for x in column:
        yield x.as_py()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that run inside pass at most ``rows`` rows at once to and from Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
