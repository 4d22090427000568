"""Topic metrics relative to the release day.

All measures of a topic come out of one pass: posts are exploded to topics, reduced per
(study, topic, video) on the map side, and reduced again per (study, topic). A null topic
stands for the whole study, so overall figures need no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import measures as M

STANCE_COLUMNS = {
    "support": vocab.SUPPORT, "oppose": vocab.OPPOSE, "neutral": vocab.NEUTRAL,
    "mixed": vocab.MIXED, "unclear": vocab.UNCLEAR,
}
_BITS = 60
_SUMS = ["count", *STANCE_COLUMNS, "engagement_sum", "oppose_sum", "dated", "index_sum", "launch_n", "ferment_n"]


def topic_rows(relevant: DataFrame, with_overall: bool = False) -> DataFrame:
    """One row per (post, topic) with topic_seq, the position of its first mention."""
    topics = F.col("topics")
    if with_overall:
        topics = F.array_append(topics, F.lit(None).cast("string"))
    return (
        relevant.select("*", F.posexplode(topics).alias("topic_pos", "topic"))
        .withColumn("topic_seq", F.struct("post_seq", "topic_pos"))
    )


def _stance_counts() -> list[Column]:
    return [F.count_if(F.col("stance") == label).alias(name) for name, label in STANCE_COLUMNS.items()]


def _day_bits(word: int) -> Column:
    index = F.col("day_index") - F.lit(word * _BITS)
    bit = F.expr(f"shiftleft(1L, cast(day_index - {word * _BITS} as int))")
    return F.bit_or(F.when(F.col("in_window") & index.between(0, _BITS - 1), bit).otherwise(F.lit(0).cast("long")))


def topic_rollup(relevant: DataFrame, videos: DataFrame, longest: int | None = None) -> DataFrame:
    """Sums per (study, topic); the row with a null topic covers the whole study.

    longest: days of the longest study window; read from the rows where it is not given. Active days are bit sets of as many
    words as it needs.
    """
    if longest is None:
        longest = relevant.agg(F.max("window_days")).first()[0] or 1
    n_words = -(-longest // _BITS)
    rows = topic_rows(relevant, with_overall=True)
    in_window = F.col("in_window")
    per_video = rows.groupBy("study_id", "topic", "video_id").agg(
        F.count(F.lit(1)).alias("count"),
        *_stance_counts(),
        F.sum(F.log1p(F.col("likes") + F.col("reply_count"))).alias("engagement_sum"),
        F.sum(F.when(F.col("stance") == vocab.OPPOSE, F.col("intensity")).otherwise(0)).alias("oppose_sum"),
        F.count_if(in_window).alias("dated"),
        F.sum(F.when(in_window, F.col("day_index")).otherwise(0)).alias("index_sum"),
        F.count_if(in_window & F.col("day_offset").between(0, 7)).alias("launch_n"),
        F.count_if(in_window & (F.col("day_offset") >= 8)).alias("ferment_n"),
        F.min("topic_seq").alias("topic_seq"),
        F.max("window_days").alias("window_days"),
        *[_day_bits(w).alias(f"days{w}") for w in range(n_words)],
    )
    return per_topic(per_video, videos, n_words)


def per_topic(per_video: DataFrame, videos: DataFrame, n_words: int) -> DataFrame:
    """Sums per (study, topic) from sums per (study, topic, video) whose active days are bit sets of n_words words."""
    known = videos.select("study_id", "video_id", "category")
    joined = per_video.join(known, ["study_id", "video_id"], "left")
    totals = joined.groupBy("study_id", "topic").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("topic_seq").alias("topic_seq"),
        F.max("window_days").alias("window_days"),
        F.count(F.lit(1)).alias("video_count"),
        *[F.bit_or(f"days{w}").alias(f"days{w}") for w in range(n_words)],
        *[F.max(F.when(F.col("category") == c, 1).otherwise(0)).alias(f"has_{c}") for c in vocab.CATEGORIES],
    )
    active = sum((F.bit_count(F.col(f"days{w}")) for w in range(1, n_words)), F.bit_count(F.col("days0")))
    categories = F.array_compact(F.array(*[
        F.when(F.col(f"has_{c}") == 1, F.lit(c)) for c in sorted(vocab.CATEGORIES)]))
    return (
        totals
        .withColumn("abstain", F.col("count") - sum((F.col(c) for c in STANCE_COLUMNS), F.lit(0)))
        .withColumn("active_days", active.cast("long"))
        .withColumn("video_categories", categories)
        .drop(*[f"days{w}" for w in range(n_words)], *[f"has_{c}" for c in vocab.CATEGORIES])
    )


def reply_conflict(relevant: DataFrame) -> DataFrame:
    """Share of opposing reply edges per study, over edges whose two stances are support or oppose.

    Children are counted per (parent, stance) first, so a post with very many replies
    contributes at most two rows to the join.
    """
    polar = relevant.where(F.col("stance").isin(vocab.SUPPORT, vocab.OPPOSE))
    children = (
        polar.where("parent_id is not null and parent_id <> ''")
        .groupBy("study_id", F.col("parent_id").alias("post_id"), F.col("stance").alias("child_stance"))
        .agg(F.count(F.lit(1)).alias("n")))
    parents = polar.select("study_id", "post_id", "stance")
    edges = children.join(parents, ["study_id", "post_id"])
    return edges.groupBy("study_id").agg(
        F.sum("n").alias("edges"),
        F.sum(F.when(F.col("stance") != F.col("child_stance"), F.col("n")).otherwise(0)).alias("opposed"),
    ).withColumn("reply_conflict", M.ratio(F.col("opposed"), F.col("edges")))


def video_totals(videos: DataFrame) -> DataFrame:
    return videos.groupBy("study_id").agg(F.count(F.lit(1)).alias("all_videos"))


def topic_metrics(rollup: DataFrame, videos: DataFrame, conflict: DataFrame) -> DataFrame:
    """The full metric row of every topic."""
    study = W.partitionBy("study_id")
    base = (
        rollup.withColumn("n_valid", F.max(F.when(F.col("topic").isNull(), F.col("count"))).over(study))
        .where("topic is not null")
        .join(video_totals(videos), "study_id", "left")
        .join(conflict.select("study_id", "reply_conflict"), "study_id", "left")
        .withColumn("all_videos", F.greatest(F.coalesce(F.col("all_videos"), F.lit(0)), F.lit(1)))
    )
    s, o, n, m = (F.col(c) for c in ("support", "oppose", "neutral", "mixed"))
    stanced = s + o + n + m
    out = (
        base
        .withColumn("topic_share", M.ratio(F.col("count"), F.col("n_valid")))
        .withColumn("net_support", M.net_support(s, o))
        .withColumn("support_rate", M.ratio(s, s + o))
        .withColumn("entropy", M.entropy_norm(s, o, n, m))
        .withColumn("volume", M.volume_norm(F.col("count"), F.greatest(F.col("n_valid"), F.lit(1))))
        .withColumn("controversy", M.controversy(F.col("entropy"), F.col("reply_conflict"), F.col("volume")))
        .withColumn("trend_speed", M.trend_speed(F.col("window_days"), F.col("dated"), F.col("index_sum")))
        .withColumn("engagement", F.col("engagement_sum") / F.col("count"))
        .withColumn("persistence", M.persistence(
            F.col("active_days"), F.col("window_days"), F.col("video_count"), F.col("all_videos")))
        .withColumn("oppose_intensity", F.coalesce(
            M.ratio(o, stanced) * M.ratio(F.col("oppose_sum"), o) / 3, F.lit(0.0)))
        .withColumn("growth_delta", (F.col("ferment_n") - F.col("launch_n")) / F.col("count"))
        .withColumn("video_coverage", F.least(F.lit(1.0), F.col("video_count") / F.col("all_videos")))
        .withColumn("ugc_diffusion", M.ugc_diffusion(
            F.size("video_categories") / 5, F.col("video_coverage"), F.col("growth_delta")))
        .withColumn("per_1000", M.per_thousand(F.col("count"), F.col("n_valid")))
        .withColumn("per_10_videos", M.per_ten(F.col("video_count"), F.col("all_videos")))
    )
    return out.drop("engagement_sum", "oppose_sum", "dated", "index_sum")


def overall(rollup: DataFrame) -> DataFrame:
    return (
        rollup.where("topic is null")
        .withColumn("net_support", M.net_support(F.col("support"), F.col("oppose")))
        .select("study_id", F.col("count").alias("n_valid"), *STANCE_COLUMNS, "abstain", "net_support"))


def daily_counts(relevant: DataFrame, studies: DataFrame) -> DataFrame:
    """Dense day series: one row per (study, topic, window day), zero where nothing was written."""
    counts = (
        topic_rows(relevant).where("in_window")
        .groupBy("study_id", "topic", "day_index").agg(F.count(F.lit(1)).alias("n")))
    days = studies.select(
        "study_id", F.explode(F.sequence(F.lit(0), F.col("ferment_hi") - F.col("preheat_lo"))).alias("day_index"))
    # Topics without a dated post keep an all-zero series, so the topic list comes from all rows.
    topics = topic_rows(relevant).groupBy("study_id", "topic").agg(F.min("topic_seq").alias("topic_seq"))
    return (
        topics.join(days, "study_id")
        .join(counts, ["study_id", "topic", "day_index"], "left")
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long"))))


def daily_arrays(daily: DataFrame) -> DataFrame:
    """One array per topic in day order; its length is the study window, not the data."""
    pairs = F.array_sort(F.collect_list(F.struct("day_index", "n")))
    return (daily.groupBy("study_id", "topic").agg(pairs.alias("p"))
            .select("study_id", "topic", F.col("p.n").alias("daily_counts")))


def phase_totals(relevant: DataFrame) -> DataFrame:
    return topic_rows(relevant).groupBy("study_id", "topic").agg(
        *[F.count_if(F.col("phase") == p).alias(p) for p in ("preheat", "launch", "ferment")])


def dataset_counts(posts: DataFrame, annotations: DataFrame, videos: DataFrame, rollup: DataFrame) -> DataFrame:
    """Row counts per study; abstained and irrelevant rows are counted over all annotations."""
    from .effective import is_effective

    per_posts = posts.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("total_posts"), F.count_if(is_effective(F.col("flags"))).alias("effective_posts"))
    per_labels = annotations.groupBy("study_id").agg(
        F.count_if(F.col("relevant").isNull()).alias("abstain_count"),
        F.count_if(~F.col("relevant")).alias("irrelevant_count"))
    relevant = rollup.where("topic is null").select("study_id", F.col("count").alias("relevant_posts"))
    out = (per_posts.join(per_labels, "study_id", "left").join(relevant, "study_id", "left")
           .join(video_totals(videos).withColumnRenamed("all_videos", "videos"), "study_id", "left"))
    return out.na.fill(0)
