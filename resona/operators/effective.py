"""Study windows, effective posts and the relevant set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXCLUDING_FLAGS = ["duplicate", "spam", "lottery", "ad"]


def day_offset(published_date: Column, t0_date: Column) -> Column:
    return F.datediff(published_date, t0_date)


def phase_of(offset: Column) -> Column:
    def between(lo: str, hi: str) -> Column:
        return offset.between(F.col(lo), F.col(hi))

    return (F.when(between("preheat_lo", "preheat_hi"), F.lit("preheat"))
            .when(between("launch_lo", "launch_hi"), F.lit("launch"))
            .when(between("ferment_lo", "ferment_hi"), F.lit("ferment")))


def with_offsets(posts: DataFrame, studies: DataFrame) -> DataFrame:
    """Add day_offset, phase, day_index (0 = first window day) and in_window to every post.

    studies holds one row per study; Spark broadcasts it when it is below the size threshold.
    """
    windows = studies.select(
        "study_id", "t0_date", "preheat_lo", "preheat_hi", "launch_lo", "launch_hi", "ferment_lo", "ferment_hi")
    return (
        posts.join(windows, "study_id")
        .withColumn("day_offset", day_offset(F.col("published_date"), F.col("t0_date")))
        .withColumn("phase", phase_of(F.col("day_offset")))
        .withColumn("day_index", F.col("day_offset") - F.col("preheat_lo"))
        .withColumn("in_window", F.col("day_offset").between(F.col("preheat_lo"), F.col("ferment_hi")))
        .withColumn("window_days", F.col("ferment_hi") - F.col("preheat_lo") + 1)
        .drop("preheat_lo", "preheat_hi", "launch_lo", "launch_hi", "ferment_lo", "ferment_hi", "t0_date")
    )


def is_effective(flags: Column) -> Column:
    blocked = F.array(*[F.lit(f) for f in EXCLUDING_FLAGS])
    return ~F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), blocked)


def effective_posts(posts: DataFrame) -> DataFrame:
    return posts.where(is_effective(F.col("flags")))


def last_annotation(annotations: DataFrame) -> DataFrame:
    """One annotation per post: the last one written wins.

    The window sorts by the join key, so the join with posts needs no further shuffle or sort.
    """
    order = W.partitionBy("study_id", "post_id").orderBy(F.col("ann_seq").desc())
    return annotations.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def relevant_posts(posts_with_offsets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Effective posts whose annotation says relevant = true, with their labels."""
    labels = last_annotation(annotations).where(F.col("relevant").eqNullSafe(True))
    return effective_posts(posts_with_offsets).join(labels, ["study_id", "post_id"])


def prefilter_trades(posts: DataFrame, pattern: str) -> DataFrame:
    return posts.where(~F.col("text").rlike(pattern))


def restrict_to(posts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep candidate posts; an empty candidate table means no restriction."""
    if candidates.isEmpty():
        return posts
    return posts.join(candidates.select("study_id", "post_id"), ["study_id", "post_id"], "left_semi")
