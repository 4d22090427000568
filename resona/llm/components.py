"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Links up to so many (a few MB) stay in one partition, where minima and joins need no exchange; more are shuffled.
ONE_PART = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every id in a link; ids of any type with an order.

    Each round points the neighbours of an id at the smallest of them, first the larger neighbours, then the smaller
    ones and the id itself, until nothing changes: a number of rounds that grows with the logarithm of the longest path. All steps are
    combined minima and joins; no neighbour list is collected. Null ends and links of an id to itself are left out.

    edges should be a stored table, as its links are counted first. The rounds are the same for few and for many links; few would else cost
    thousands of empty tasks and files a call where there are many shuffle partitions.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    few = links.count() <= ONE_PART

    def packed(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    links = packed(checkpointed(packed(links).distinct()))
    before = None
    while True:
        both = packed(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = packed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = packed(large.join(small, "u"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = packed(checkpointed(joined.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()))
        # Sums of two hashes in exact decimals tell whether the set of links is still the same.
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                              F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return packed(links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")))).distinct()
