"""Distributed numbering of ordered results.

``row_number() over (order by ...)`` without a partition moves every row into
one task. ``global_row_number`` numbers rows of a total order without that:
the range-partitioned sort keeps each partition ordered, each row is tagged with
its partition and position and written once, per-partition counts (one row per
partition, a bound known before the job) are prefix-summed and broadcast, and
each row adds its offset inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zipledger.session import materialize


def running(rows: DataFrame, key: str, bucket: str, order: list, amount: Column) -> DataFrame:
    """``rows`` with ``running``: the sum of ``amount`` over a key's rows before each.

    Two levels, so that a key with a large share of all rows is no single window: sums of
    buckets are added up per key, and rows within their bucket only."""
    rows = rows.withColumn("_amount", amount)
    sums = rows.groupBy(key, bucket).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(key, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_here", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
            .join(offs, [key, bucket]).withColumn("running", F.col("_off") + F.col("_here"))
            .drop("_amount", "_off", "_here"))


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Append a 1-based ``name`` numbering ``df`` in ``order``.

    ``order`` must be a total order (end with unique columns); otherwise the
    numbering of ties is unspecified, as it is for the reference.
    """
    # (partition, position) are written once, so the counts and the rows below
    # see the same numbering whatever AQE does to either branch
    tagged = materialize(df.orderBy(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off"))
