"""The vector baseline as numbers: relevance and topics by similarity to topic centroids, against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import stage_table
from . import evaluate, topics
from .sampling import grouped_split

RELEVANT, IRRELEVANT, ABSTAIN = "relevant", "irrelevant", "abstain"
KEY = ["study_id", "post_id", "video_id", "relevant", "gold_topics"]


def predictions(posts: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test rows (KEY, best, predicted topics) and per study the thresholds and sizes of the split.

    posts: KEY and vector. Videos are split 70 to 30; thresholds come from the training part only. relevant is null for an abstained gold row,
    which is in no threshold for relevance but counts in the scores.
    """
    sims = topics.dense_similarity(posts, centroids, KEY).withColumn("similarity", F.round("similarity", 12))
    sims = stage_table(sims.join(grouped_split(posts, "video_id"), ["study_id", "video_id"]), "baseline")
    rows = topics.baseline_rows(sims, [*KEY, "part"])
    limits = topics.baseline_thresholds(rows.where("part = 'train'"))
    test = F.col("part") == "test"
    sizes = rows.groupBy("study_id").agg(
        F.count_if(~test).alias("train"), F.count_if(test).alias("test"),
        F.count_distinct(F.when(~test, F.col("video_id"))).alias("train_videos"), F.count_distinct(F.when(test, F.col("video_id"))).alias("test_videos"))
    limits = sizes.join(limits, "study_id", "left").withColumnsRenamed({"relevance": "relevance_threshold", "topics": "topics_threshold"}).na.fill(
        vocab.BASELINE_THRESHOLD, ["relevance_threshold", "topics_threshold"])
    limited = sims.where(test).join(limits.select("study_id", "relevance_threshold", "topics_threshold"), "study_id")
    best = limited.groupBy(*KEY, "relevance_threshold").agg(F.max("similarity").alias("best")).withColumn(
        "predicted", F.col("best") >= F.col("relevance_threshold")).drop("relevance_threshold")
    named = topics.assign(limited, KEY, F.col("topics_threshold")).withColumnRenamed("topics", "predicted_topics")
    same = [best[k].eqNullSafe(named[k]) for k in ("study_id", "post_id")]
    return best.join(named.select("study_id", "post_id", "predicted_topics"), same[0] & same[1]).select(
        *[best[k] for k in KEY], "best", "predicted", "predicted_topics"), limits


def vector_baseline(posts: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per study relevance_f1 (over the two classes, abstained gold rows counted as a third), topics_f1 (over all labels), thresholds, sizes."""
    test, limits = predictions(posts, centroids)
    test = stage_table(test, "baseline-test")
    truth = F.when(F.col("relevant"), RELEVANT).when(~F.col("relevant"), IRRELEVANT).otherwise(ABSTAIN)
    pairs = test.select("study_id", truth.alias("y_true"), F.when(F.col("predicted"), RELEVANT).otherwise(IRRELEVANT).alias("y_pred"))
    relevance = evaluate.macro_f1(pairs, [RELEVANT, IRRELEVANT], ["study_id"]).select("study_id", F.col("macro_f1").alias("relevance_f1"))
    sets = test.select("study_id", F.col("gold_topics").alias("y_true"), F.col("predicted_topics").alias("y_pred"))
    by_topic = evaluate.multilabel_scores(sets, vocab.TOPICS, ["study_id"]).groupBy("study_id").agg(F.avg("f1").alias("topics_f1"))
    return limits.join(relevance, "study_id", "left").join(by_topic, "study_id", "left")
