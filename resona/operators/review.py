"""Routing to review, the review queue, and the merge of human corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from .effective import last_annotation
from .order_stats import at_fraction, order_statistics
from .skew import join_groups

VALUE_FIELDS = vocab.REVIEW_FIELDS
REFUSALS = ("unknown_post", "bad_field", "reason_missing")


def audit_draw(post_id: Column, ratio: float = vocab.AUDIT_RATIO, seed: str = "7") -> Column:
    return X.hash_fraction(seed, post_id) < int(ratio * 10_000)


def like_thresholds(posts: DataFrame) -> DataFrame:
    return order_statistics(posts, "likes", {
        "p95": at_fraction(vocab.LIKE_QUANTILE), "p50": lambda n: F.floor(n / 2)})


def route(posts: DataFrame, annotations: DataFrame, controversial: DataFrame | None = None,
          seed: str = "7") -> DataFrame:
    """Posts to review with the reasons why; any reason is enough."""
    limits = like_thresholds(posts)
    labels = last_annotation(annotations).select(
        "study_id", "post_id", "confidence", "irony", "topics", F.lit(True).alias("_labelled"))
    rows = posts.select("study_id", "post_id", "post_seq", "likes").join(labels, ["study_id", "post_id"], "left")
    # One row per study, also for studies without limits; a study may hold most of the posts.
    groups = posts.groupBy("study_id").agg(F.count(F.lit(1)).alias("_n")).join(limits, "study_id", "left")
    hot_topic = F.lit(False)
    if controversial is not None:
        # At most a few named topics per study: one array per study.
        hot = controversial.groupBy("study_id").agg(F.collect_set("topic").alias("_hot_topics"))
        groups = groups.join(hot, "study_id", "left")
        hot_topic = F.coalesce(F.arrays_overlap("topics", "_hot_topics"), F.lit(False))
    rows = join_groups(rows, groups, ["study_id"], "_n", "post_id")
    labelled = F.col("_labelled").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(~labelled, F.lit("no_annotation")),
        F.when(labelled & (F.col("confidence") < vocab.MIN_CONFIDENCE), F.lit("low_confidence")),
        F.when(labelled & F.col("irony").isin(*vocab.IRONY_TO_REVIEW), F.lit("irony")),
        F.when(labelled & (F.col("likes") >= F.col("p95")) & (F.col("likes") > F.col("p50")), F.lit("high_likes")),
        F.when(labelled & hot_topic, F.lit("controversial_topic")),
        F.when(labelled & audit_draw(F.col("post_id"), seed=seed), F.lit("audit"))))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).select(
        "study_id", "post_id", "post_seq", "reasons")


def queue_rows(queue: DataFrame, annotations: DataFrame, posts: DataFrame, videos: DataFrame,
               reviews: DataFrame) -> DataFrame:
    """Queue entries with text, current labels, title and the number of reviews so far."""
    key = ["study_id", "post_id"]
    counts = reviews.groupBy(*key).agg(F.count(F.lit(1)).alias("review_count"))
    labels = last_annotation(annotations).select(*key, *VALUE_FIELDS, "confidence", "stage")
    known = videos.select("study_id", "video_id", "title", "url")
    return (
        queue.select(*key, "post_seq")
        .join(posts.select(*key, "video_id", "parent_id", "text", "likes", "published_at"), key)
        .join(labels, key)
        .join(counts, key, "left")
        .join(known, ["study_id", "video_id"], "left")
        .withColumn("text", X.excerpt(F.col("text"), vocab.REVIEW_CHARS))
        .withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("long")))
        .withColumn("human_modified", F.col("review_count") > 0)
        .withColumn("video_title", F.coalesce("title", F.lit("")))
        .withColumn("video_url", F.coalesce("url", F.lit(""))).drop("title", "url"))


def as_text(name: str, value: Column) -> Column:
    """A label value as stored in the log: text as it is, anything else as JSON."""
    if name == "topics":
        # One JSON text per element, so quotes and backslashes inside are escaped.
        quoted = F.transform(value, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", ""))
        out = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("null"))


def check_proposals(proposals: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each proposed change with its value before and a status.

    Statuses: accepted, unchanged, the refusals unknown_post, bad_field, reason_missing, and stopped: a submission is read in order of
    review_seq and ends at its first refusal; what it had accepted before stays.
    """
    before = F.create_map(*[x for f in VALUE_FIELDS for x in (F.lit(f), as_text(f, F.col(f)))])
    labels = last_annotation(annotations).select("study_id", "post_id", before.alias("_before"))
    rows = proposals.join(labels, ["study_id", "post_id"], "left").withColumn(
        "before", F.try_element_at("_before", "field"))
    status = (F.when(F.col("_before").isNull(), F.lit("unknown_post"))
              .when(~F.col("field").isin(*VALUE_FIELDS), F.lit("bad_field"))
              .when(F.col("before") == F.col("after"), F.lit("unchanged"))
              .when(F.coalesce("reason", F.lit("")) == "", F.lit("reason_missing"))
              .otherwise(F.lit("accepted")))
    checked = rows.withColumn("status", status).drop("_before")
    # A submission is what one person sends for one post: a handful of rows.
    own = W.partitionBy("study_id", "post_id", "submission_id")
    refused = F.min(F.when(F.col("status").isin(*REFUSALS), F.col("review_seq"))).over(own)
    return checked.withColumn("_end", refused).withColumn(
        "status", F.when(F.col("review_seq") > F.col("_end"), F.lit("stopped")).otherwise(F.col("status"))).drop("_end")


def log_rows(checked: DataFrame) -> DataFrame:
    """Rows for the review log: each accepted change, or one accept row when nothing changed."""
    changed = checked.where("status = 'accepted'").select(
        "study_id", "post_id", "submission_id", "field", "before", "after", "reason", "reviewer", "reviewed_at")
    per_submission = checked.groupBy("study_id", "post_id", "submission_id").agg(
        F.count_if(F.col("status") != "unchanged").alias("_other"),
        F.min("reviewer").alias("reviewer"), F.max("reviewed_at").alias("reviewed_at"))
    plain = per_submission.where("_other = 0").select(
        "study_id", "post_id", "submission_id", F.lit("").alias("field"), F.lit("").alias("before"),
        F.lit("").alias("after"), F.lit("接受模型标签").alias("reason"), "reviewer", "reviewed_at")
    return changed.unionByName(plain)


def latest_values(reviews: DataFrame) -> DataFrame:
    """The last human value per (post, field)."""
    return reviews.where(F.col("field").isin(*VALUE_FIELDS)).groupBy("study_id", "post_id", "field").agg(
        F.max_by("after", F.struct("reviewed_at", "review_seq")).alias("after"))


def _typed(name: str, after: Column, dtype: str) -> Column:
    if name == "topics":
        return F.from_json(after, "array<string>")
    if name in ("relevant", "intensity"):
        return after.try_cast(dtype)
    unquoted = F.when(after.rlike(r'^\s*"'), F.coalesce(F.get_json_object(F.concat(F.lit("["), after, F.lit("]")),
                                                                          "$[0]"), after)).otherwise(after)
    return F.when(after != "null", unquoted)


def _readable(name: str, after: Column, typed: Column) -> Column:
    """Whether a logged value fits its field; null does for all fields but topics, intensity and irony."""
    if name in ("topics", "intensity", "irony"):
        return typed.isNotNull()
    return typed.isNotNull() | (after == "null")


def unreadable_values(annotations: DataFrame, reviews: DataFrame) -> DataFrame:
    """The latest human values (study_id, post_id, field, after) that don't fit their field; merge leaves those fields as they are."""
    kinds = {f: annotations.schema[f].dataType.simpleString() for f in VALUE_FIELDS}
    after = F.col("after")
    bad = F.coalesce(*[F.when(F.col("field") == f, ~_readable(f, after, _typed(f, after, k))) for f, k in kinds.items()])
    return latest_values(reviews).where(bad)


def merge(annotations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Annotations with the latest human values; a changed row has stage human and needs no review (where there is such a column).

    A value that doesn't fit its field is left out (see unreadable_values).
    """
    values = latest_values(reviews).groupBy("study_id", "post_id").agg(*[
        F.max(F.when(F.col("field") == f, F.struct("after"))).alias(f"_{f}") for f in VALUE_FIELDS],
        F.lit(True).alias("_touched"))
    base = last_annotation(annotations)
    out = base.join(values, ["study_id", "post_id"], "left")
    for f in VALUE_FIELDS:
        dtype = base.schema[f].dataType.simpleString()
        after = F.col(f"_{f}.after")
        typed = _typed(f, after, dtype)
        out = out.withColumn(f, F.when(F.col(f"_{f}").isNotNull() & _readable(f, after, typed), typed).otherwise(F.col(f)))
    if "needs_review" in base.columns:
        out = out.withColumn("needs_review", F.when(F.col("_touched"), F.lit(False)).otherwise(F.col("needs_review")))
    return (out.withColumn("human_modified", F.col("_touched").isNotNull())
            .withColumn("stage", F.when(F.col("_touched"), F.lit("human")).otherwise(F.col("stage")))
            .drop("_touched", *[f"_{f}" for f in VALUE_FIELDS]))


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("study_id", "post_id").agg(F.count(F.lit(1)).alias("reviews"))
