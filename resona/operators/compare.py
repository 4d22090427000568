"""Two studies side by side on the same relative window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M


def _side(topics: DataFrame, study_id: str, side: str) -> DataFrame:
    return topics.where(F.col("study_id") == study_id).select(
        "topic",
        F.bround("per_1000", 1).alias(f"{side}_per_1000"),
        F.col("topic_share").alias(f"{side}_share"),
        F.col("net_support").alias(f"{side}_net_support"),
        F.col("controversy").alias(f"{side}_controversy"),
        F.bround("per_10_videos", 1).alias(f"{side}_per_10_videos"),
        F.col("trend_speed").alias(f"{side}_trend"),
        F.col("count").alias(f"{side}_count"))


def topic_comparison(topics: DataFrame, a: str, b: str) -> DataFrame:
    """Union of both topic lists; the side without a topic stays null."""
    return _side(topics, a, "a").join(_side(topics, b, "b"), "topic", "full_outer")


def sample_gap(overall: DataFrame, a: str, b: str) -> DataFrame:
    sides = overall.groupBy().agg(
        F.max(F.when(F.col("study_id") == a, F.col("n_valid")).otherwise(0)).alias("a_posts"),
        F.max(F.when(F.col("study_id") == b, F.col("n_valid")).otherwise(0)).alias("b_posts"))
    return sides.withColumn("sample_gap", M.sample_gap(F.col("a_posts"), F.col("b_posts")))


def study_notes(studies: DataFrame, a: str, b: str) -> DataFrame:
    """Whether both studies share the release day; their relative windows always match."""
    pick = studies.where(F.col("study_id").isin(a, b))
    return pick.agg((F.count_distinct("t0_date") == 1).alias("windows_identical"),
                    F.lit(True).alias("same_relative_window"))
