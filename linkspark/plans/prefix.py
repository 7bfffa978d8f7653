"""Running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.plans.staging import stage


def running(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """Add ``run_<c>``, the inclusive sum of ``c`` in ascending ``order`` (whose values are distinct), and ``prev``, the value before.

    Rows are range-partitioned and written; each partition sums its own rows
    and starts from the totals of those before it, one row per partition.
    """
    parts = stage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("pid__", F.spark_partition_id()), "running")
    totals = parts.groupBy("pid__").agg(*(F.sum(c).alias(f"t_{c}") for c in sums), F.max(order).alias("top__"))
    before = Window.orderBy("pid__").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("pid__", *(F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in sums), F.last("top__").over(before).alias("last__"))
    inside = Window.partitionBy("pid__").orderBy(order)
    here = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(starts), "pid__")
    return out.select(*df.columns, *((F.col(f"b_{c}") + F.sum(c).over(here)).alias(f"run_{c}") for c in sums), F.coalesce(F.lag(order).over(inside), F.col("last__")).alias("prev"))
