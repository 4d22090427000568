"""Evidence rows behind every number, and the claims built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from ..rules import DEFAULT, Rules


def evidence_items(relevant: DataFrame, videos: DataFrame, modified: DataFrame | None = None) -> DataFrame:
    """One row per relevant post; title and address fall back to the post's own fields."""
    known = videos.select("study_id", "video_id", F.col("title"), F.col("url"))
    out = relevant.join(known, ["study_id", "video_id"], "left")
    if modified is None:
        human = F.lit(False)
    else:
        marks = modified.select("study_id", "post_id").distinct().withColumn("_human", F.lit(True))
        out = out.join(marks, ["study_id", "post_id"], "left")
        human = F.coalesce(F.col("_human"), F.lit(False))
    return out.select(
        "study_id", "post_seq", F.col("post_id").alias("evidence_id"), "video_id",
        F.coalesce("title", "video_id").alias("video_title"),
        F.coalesce("url", "source_url").alias("video_url"),
        X.excerpt(F.col("text"), vocab.EXCERPT_CHARS).alias("text_excerpt"),
        "published_at", "likes", "topics", "stance", "emotion", "irony",
        F.col("stage").alias("model_label_stage"), "confidence", human.alias("human_modified"), "source_url")


def representative(relevant: DataFrame, per_stance: int = 3) -> DataFrame:
    """Top posts per (study, topic, stance) by likes, id as tie-break.

    Spark prunes each input partition to per_stance rows per group before the shuffle, so a
    topic holding most of the data costs no more than a small one.
    """
    from .metrics import topic_rows

    rows = topic_rows(relevant).select(
        "study_id", "topic", F.coalesce("stance", F.lit(vocab.NO_STANCE)).alias("stance"),
        F.col("post_id").alias("evidence_id"), "likes", "post_seq")
    w = W.partitionBy("study_id", "topic", "stance").orderBy(F.col("likes").desc(), F.col("evidence_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_stance)


def stance_first_seen(relevant: DataFrame) -> DataFrame:
    from .metrics import topic_rows

    return (topic_rows(relevant)
            .groupBy("study_id", "topic", F.coalesce("stance", F.lit(vocab.NO_STANCE)).alias("stance"))
            .agg(F.min("post_seq").alias("first_seq")))


def _fixed(x: Column, digits: int) -> Column:
    # Half-even on the decimal digits first: the formatter alone would round halves up.
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def _signed(x: Column) -> Column:
    return F.format_string("%+.2f", F.bround(x, 2))


def claims(topics: DataFrame, ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """Three issue claims and two opportunity claims per study, each citing metrics and evidence."""
    best = representative(relevant)
    first = stance_first_seen(relevant)
    picked = (
        best.join(first, ["study_id", "topic", "stance"])
        .groupBy("study_id", "topic")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("first_seq", "rank", "evidence_id"))), 1, 3).alias("e"))
        .select("study_id", "topic", F.col("e.evidence_id").alias("evidence_ids")))
    top = ranking.where("(kind = 'issue' and rank <= 3) or (kind = 'opportunity' and rank <= 2)")
    rows = (
        top.select("study_id", "kind", "topic", "rank")
        .join(topics, ["study_id", "topic"]).join(picked, ["study_id", "topic"], "left"))
    t = F.col("topic")
    missing = F.lit(vocab.NOT_AVAILABLE)
    small = F.when(F.col("count") < vocab.SMALL_SAMPLE, F.lit(vocab.SMALL_SAMPLE_MARK)).otherwise(F.lit(""))
    issue_text = F.format_string(
        vocab.ISSUE_CLAIM, t, F.coalesce(_signed(F.col("net_support")), missing), _fixed(F.col("controversy"), 2),
        F.col("count"), small)
    percent = F.concat(_fixed(F.col("support_rate") * 100, 0), F.lit("%"))
    opp_text = F.format_string(
        vocab.OPPORTUNITY_CLAIM, t, F.coalesce(percent, missing), F.col("video_count"), F.col("count"), small)
    is_issue = F.col("kind") == "issue"
    issue_metrics = F.array(
        F.concat(F.lit("topics."), t, F.lit(".net_support_rate")), F.concat(F.lit("topics."), t, F.lit(".controversy")),
        F.concat(F.lit("composites.issue_priority.scores."), t))
    opp_metrics = F.array(
        F.concat(F.lit("topics."), t, F.lit(".support_rate")),
        F.concat(F.lit("composites.opportunity.scores."), t))
    return rows.select(
        "study_id", "kind", "rank",
        F.concat(F.when(is_issue, F.lit("issue-")).otherwise(F.lit("opp-")), t).alias("claim_id"),
        F.when(is_issue, issue_text).otherwise(opp_text).alias("text"),
        F.when(is_issue, issue_metrics).otherwise(opp_metrics).alias("metric_ids"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        F.col("count").alias("topic_sample_size"))


def verify_claims(claim_rows: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Violations of the claim rules: citations, over-generalisation, causal wording, small samples."""
    def hit(cond: Column, rule: str, detail: str) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(detail).alias("detail")))

    checks = [
        hit(F.size("metric_ids") <= 0, "citation", "metric_id"),
        hit(F.size("evidence_ids") <= 0, "citation", "evidence_id"),
        *[hit(F.col("text").rlike(p), "overreach", p) for p in rules.overreach],
        *[hit(F.col("text").rlike(p), "causal", p) for p in rules.causal],
        hit((F.col("topic_sample_size") < vocab.SMALL_SAMPLE) & ~F.contains(F.col("text"), F.lit("小样本")),
            "small_sample", "小样本"),
    ]
    return claim_rows.select("study_id", "claim_id", F.inline(F.array_compact(F.array(*checks))))


def passing_report(claim_rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Claims of the studies without any violation."""
    return claim_rows.join(violations.select("study_id").distinct(), "study_id", "left_anti")
