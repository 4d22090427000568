"""Joins on keys of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_GROUPS = 100_000
SALTS = 64


def hot_keys(groups: DataFrame, keys: list[str], n_col: str) -> DataFrame:
    """Keys that hold more than 1/MAX_HOT_GROUPS of all counted rows.

    There can be at most MAX_HOT_GROUPS of them, so the result is safe to broadcast whatever
    the size of the data.
    """
    limit = groups.agg(F.coalesce(F.sum(n_col), F.lit(0)) / F.lit(MAX_HOT_GROUPS))
    return groups.where(F.col(n_col) > F.greatest(limit.scalar(), F.lit(10_000.0))).select(
        *keys, F.lit(True).alias("_hot"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Add _salt: rows of a hot key get one of SALTS values, others 0."""
    zero = F.lit(0).cast("long")
    return rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(zero)).drop("_hot")


def replicated(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The other side of a salted join: rows of a hot key appear once per salt."""
    zero = F.lit(0).cast("long")
    every = F.sequence(zero, F.lit(SALTS - 1).cast("long"))
    return rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(zero)))).drop("_hot")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_col: str, spread_by: str,
                how: str = "left") -> DataFrame:
    """rows JOIN groups on keys; groups has one row per key with the number of its rows in n_col."""
    hot = hot_keys(groups, keys, n_col)
    return (salted(rows, hot, keys, spread_by)
            .join(replicated(groups.drop(n_col), hot, keys), [*keys, "_salt"], how).drop("_salt"))
