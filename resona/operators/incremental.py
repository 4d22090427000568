"""Topic metrics kept up to date under corrections.

A store holds three small tables, each a ledger of batches that are only added:
cells  signed sums per (study, topic, video, day); the null topic stands for the whole study,
edges  signed counts of reply edges and of opposed ones per study,
firsts the first mention of every topic that a batch has moved, null where the topic is gone.
A batch subtracts what its posts were and adds what they are. A least value can't be subtracted from: where a batch takes away the
very first mention, and only then, the mentions of these topics are read again. Sums are integers and decimals, so that taking away
leaves no trace. A batch writes folders of its own number and reads earlier ones only: done twice, it replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import measures as M
from ..session import stage_table
from . import effective, metrics

CELL = ["study_id", "topic", "video_id", "day_offset", "day_index", "in_window", "window_days"]
SUMS = ["count", *metrics.STANCE_COLUMNS, "engagement_sum", "oppose_sum"]
POST = ["study_id", "post_id"]
LABELS = ["ann_seq", "relevant", "topics", "stance", "intensity"]


def _cells(relevant: DataFrame) -> DataFrame:
    return metrics.topic_rows(relevant, with_overall=True).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("count"), *[F.count_if(F.col("stance") == v).alias(n) for n, v in metrics.STANCE_COLUMNS.items()],
        F.sum(F.log1p(F.col("likes") + F.col("reply_count")).cast("decimal(20,12)")).alias("engagement_sum"),
        F.sum(F.when(F.col("stance") == vocab.OPPOSE, F.col("intensity")).otherwise(0).cast("long")).alias("oppose_sum"))


#: What cells, mentions and edges need of a relevant post.
USED = [*POST, "post_seq", "parent_id", "video_id", "likes", "reply_count", "day_offset", "day_index", "in_window", "window_days", "topics", "stance", "intensity"]


def _stored(relevant: DataFrame, name: str) -> DataFrame:
    """The columns of relevant posts that a store needs, written once, as they are read several times."""
    return stage_table(relevant.select(*USED), name)


def _mentions(relevant: DataFrame) -> DataFrame:
    return metrics.topic_rows(relevant, with_overall=True).select("study_id", "topic", "topic_seq")


def _edges(relevant: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Edges and opposed edges per study; of those with a changed post at an end where changed posts are given."""
    polar = relevant.where(F.col("stance").isin(vocab.SUPPORT, vocab.OPPOSE)).select(*POST, "parent_id", "stance")
    if changed is not None:
        polar = polar.join(changed.select(*POST, F.lit(True).alias("_new")), POST, "left")
    else:
        polar = polar.withColumn("_new", F.lit(True))
    new = F.coalesce("_new", F.lit(False))
    # Replies are counted per parent first, so a post with very many of them is two or four rows.
    replies = polar.where("parent_id is not null and parent_id <> ''").groupBy(
        "study_id", F.col("parent_id").alias("post_id"), F.col("stance").alias("_reply"), new.alias("_own")).agg(F.count(F.lit(1)).alias("n"))
    both = replies.join(polar.select(*POST, "stance", "_new"), POST).where(F.col("_own") | new)
    return both.groupBy("study_id").agg(
        F.sum("n").alias("edges"), F.sum(F.when(F.col("stance") != F.col("_reply"), F.col("n")).otherwise(0)).alias("opposed"))


def _signed(plus: DataFrame, minus: DataFrame, columns: list[str]) -> DataFrame:
    return plus.unionByName(minus.select(*[c for c in minus.columns if c not in columns], *[(-F.col(c)).alias(c) for c in columns]))


def _write(df: DataFrame, out: str, name: str, batch: int) -> None:
    # Sums widen decimals; all batches have one type.
    df = df.withColumns({f.name: F.col(f.name).cast("decimal(38,12)") for f in df.schema if f.name == "engagement_sum"})
    df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def _read(spark: SparkSession, out: str, name: str, before: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{out}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _firsts(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    return _read(spark, out, "firsts", before).groupBy("study_id", "topic").agg(
        F.max_by("topic_seq", "batch").alias("topic_seq")).where("topic_seq is not null")


def _same_topic(a: DataFrame, b: DataFrame):
    return (a["study_id"] == b["study_id"]) & a["topic"].eqNullSafe(b["topic"])


def start(relevant: DataFrame, out: str) -> None:
    """A new store over all relevant posts, as batch 0."""
    relevant = _stored(relevant, "store-relevant")
    _write(_cells(relevant), out, "cells", 0)
    _write(_edges(relevant), out, "edges", 0)
    _write(_mentions(relevant).groupBy("study_id", "topic").agg(F.min("topic_seq").alias("topic_seq")), out, "firsts", 0)


def correct(dated: DataFrame, old: DataFrame, new: DataFrame, changed: DataFrame, out: str, batch: int) -> None:
    """Add the batch in which the labels of the changed posts (study_id, post_id) went from old to new.

    dated: all posts with their day offsets; old and new: annotations before and after. Sums and mentions come from the changed posts
    alone. Reply edges are joined over the relevant posts before and after, so that step scans all posts; so do the mentions of topics whose
    first one is taken away.
    Posts unknown to dated or without a label change nothing; a post named twice counts once.
    """
    if batch < 1:
        raise ValueError("batch 0 is the start of a store")
    spark = dated.sparkSession
    keys = stage_table(changed.select(*POST).distinct(), "store-changed")
    old, new = (stage_table(x.select(*POST, *LABELS), name) for x, name in ((old, "store-old"), (new, "store-new")))

    def of(posts: DataFrame, labels: DataFrame) -> DataFrame:
        return effective.relevant_posts(posts.join(keys, POST, "left_semi"), labels.join(keys, POST, "left_semi"))

    was, now = _stored(of(dated, old), "store-was"), _stored(of(dated, new), "store-now")
    cells = _signed(_cells(now), _cells(was), SUMS).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS])
    _write(cells.where(" or ".join(f"{c} <> 0" for c in SUMS)), out, "cells", batch)
    after, before = (_stored(effective.relevant_posts(dated, x), name) for x, name in ((new, "store-after"), (old, "store-before")))
    edges = _signed(_edges(after, keys), _edges(before, keys), ["edges", "opposed"])
    _write(edges, out, "edges", batch)

    moved = _signed(_mentions(now).withColumn("n", F.lit(1)), _mentions(was).withColumn("n", F.lit(1)), ["n"]).groupBy(
        "study_id", "topic", "topic_seq").agg(F.sum("n").alias("n")).where("n <> 0")
    per_topic = moved.groupBy("study_id", "topic").agg(
        F.min(F.when(F.col("n") > 0, F.col("topic_seq"))).alias("_came"), F.collect_set(F.when(F.col("n") < 0, F.col("topic_seq"))).alias("_gone"))
    # Only the least of what is gone can be the first mention.
    per_topic = per_topic.withColumn("_gone", F.array_min("_gone"))
    first = _firsts(spark, out, batch).withColumnRenamed("topic_seq", "_first")
    state = per_topic.join(first, _same_topic(per_topic, first), "left").select(
        per_topic["study_id"], per_topic["topic"], "_came", "_first", (F.col("_first") == F.col("_gone")).alias("_lost"))
    lost = state.where("_lost").select("study_id", "topic")
    kept = state.where(~F.coalesce("_lost", F.lit(False))).select(
        "study_id", "topic", F.least("_first", "_came").alias("topic_seq")).where("topic_seq is not null")
    if lost.isEmpty():
        return _write(kept, out, "firsts", batch)
    every = _mentions(after)
    left = every.join(lost, _same_topic(every, lost), "left_semi").groupBy("study_id", "topic").agg(F.min("topic_seq").alias("_seq"))
    again = lost.join(left, _same_topic(lost, left), "left").select(lost["study_id"], lost["topic"], F.col("_seq").alias("topic_seq"))
    _write(kept.unionByName(again), out, "firsts", batch)


def rollup(spark: SparkSession, out: str, videos: DataFrame) -> DataFrame:
    """What metrics.topic_rollup gives for the posts as they are now."""
    cells = _read(spark, out, "cells").groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in SUMS]).where(F.col("count") > 0)
    longest = _read(spark, out, "cells").agg(F.max("window_days")).first()[0] or 1
    n_words = -(-longest // metrics._BITS)
    n, inside = F.col("count"), F.col("in_window")
    per_video = cells.groupBy("study_id", "topic", "video_id").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.sum(F.when(inside, n).otherwise(0)).alias("dated"), F.sum(F.when(inside, n * F.col("day_index")).otherwise(0)).alias("index_sum"),
        F.sum(F.when(inside & F.col("day_offset").between(0, 7), n).otherwise(0)).alias("launch_n"),
        F.sum(F.when(inside & (F.col("day_offset") >= 8), n).otherwise(0)).alias("ferment_n"),
        F.max("window_days").alias("window_days"), *[metrics._day_bits(w).alias(f"days{w}") for w in range(n_words)])
    first = _firsts(spark, out)
    placed = per_video.join(first, _same_topic(per_video, first)).drop(first["study_id"]).drop(first["topic"])
    return metrics.per_topic(placed.withColumn("engagement_sum", F.col("engagement_sum").cast("double")), videos, n_words)


def reply_conflict(spark: SparkSession, out: str) -> DataFrame:
    """What metrics.reply_conflict gives for the posts as they are now."""
    total = _read(spark, out, "edges").groupBy("study_id").agg(F.sum("edges").alias("edges"), F.sum("opposed").alias("opposed"))
    return total.where("edges > 0").withColumn("reply_conflict", M.ratio(F.col("opposed"), F.col("edges")))


def topic_metrics(spark: SparkSession, out: str, videos: DataFrame) -> DataFrame:
    return metrics.topic_metrics(rollup(spark, out, videos), videos, reply_conflict(spark, out))
