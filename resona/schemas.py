"""Spark schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

POST = T.StructType([
    T.StructField("study_id", T.StringType()),
    T.StructField("post_seq", T.LongType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("published_date", T.DateType()),
    T.StructField("likes", T.LongType()),
    T.StructField("reply_count", T.LongType()),
    T.StructField("anon_user_id", T.StringType()),
    T.StructField("flags", STRINGS),
    T.StructField("source_url", T.StringType()),
    T.StructField("synthetic", T.BooleanType()),
])

# The label fields a model, a batch or a person may fill; every key beyond these is refused.
LABEL_FIELDS = T.StructType([
    T.StructField("relevant", T.BooleanType()),
    T.StructField("topics", STRINGS),
    T.StructField("stance", T.StringType()),
    T.StructField("emotion", T.StringType()),
    T.StructField("intensity", T.LongType()),
    T.StructField("irony", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence_span", T.StringType()),
    T.StructField("abstain_reason", T.StringType()),
])

GOLD = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("study_id", T.StringType()),
    T.StructField("annotator", T.StringType()),
    T.StructField("annotator_type", T.StringType()),
    T.StructField("annotated_at", T.StringType()),
] + LABEL_FIELDS.fields + [T.StructField("note", T.StringType())])

VIDEO = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("author_type", T.StringType()),
    T.StructField("stats_snapshot", T.StructType([
        T.StructField(n, T.LongType()) for n in ("view", "like", "coin", "favorite", "share", "comment")
    ])),
])

JOURNAL = T.StructType([
    T.StructField("at", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("page", T.LongType()),
    T.StructField("items", T.LongType()),
    T.StructField("detail", T.StructType([
        T.StructField("video_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("post_ids", STRINGS),
    ])),
])
