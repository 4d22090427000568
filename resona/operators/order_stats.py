"""Exact order statistics without a global sort of rows or a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


def order_statistics(rows: DataFrame, value: str, indexes: dict[str, Callable[[Column], Column]],
                     by: str = "study_id") -> DataFrame:
    """Per group, the value at the 0-based sorted positions index(n), one column per entry.

    Rows are reduced to counts per distinct value, range-partitioned by value, and ranked
    from running sums inside each range plus the totals of the ranges before it. Only the table
    of range totals (one line per group and partition) meets in one place.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    # Written once: both uses below must see the same ranges.
    ranged = checkpointed(counts.repartitionByRange(by, value).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(by, "_part").agg(F.sum("_n").alias("_part_n"))
    earlier = W.partitionBy(by).orderBy("_part")
    offsets = parts.select(
        by, "_part",
        F.coalesce(F.sum("_part_n").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_part_n").over(W.partitionBy(by)).alias("_total"))
    inside = W.partitionBy(by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = ranged.withColumn("_cum", F.sum("_n").over(inside)).join(offsets, [by, "_part"])
    upto = F.col("_before") + F.col("_cum")
    return ranked.groupBy(by).agg(*[
        F.min(F.when(upto > index(F.col("_total")), F.col(value))).alias(name) for name, index in indexes.items()])


def at_fraction(q: float) -> Callable[[Column], Column]:
    """Position int(n*q)."""
    return lambda n: F.floor(n * F.lit(q))
