"""A study run from raw posts and labels to stored metric tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import composite, effective, evidence, metrics, normalize, study_clusters, topics
from ..rules import DEFAULT, Rules
from ..session import checkpointed, stage_table
from .resume import Run

RELEVANT_COLUMNS = [
    "study_id", "post_seq", "post_id", "parent_id", "video_id", "likes", "reply_count", "day_offset", "day_index",
    "in_window", "window_days", "phase", "topics", "stance", "intensity",
]


def metric_tables(posts: DataFrame, annotations: DataFrame, videos: DataFrame, studies: DataFrame, store: Run | None = None) -> dict[str, DataFrame]:
    """relevant, rollup and topics of all studies.

    Posts and labels are joined once: the relevant rows are stored as a narrow columnar table
    (no text), which the topic pass and the reply pass both read. The two topic-sized results are
    checkpointed, so that rankings, claims and views do not repeat the passes. With a store, all three are stages of its folder,
    and those it has already are not computed again.
    """
    def build_relevant() -> DataFrame:
        return effective.relevant_posts(effective.with_offsets(posts, studies), annotations).select(*RELEVANT_COLUMNS)

    def build_rollup() -> DataFrame:
        longest = studies.agg(F.max(F.col("ferment_hi") - F.col("preheat_lo") + 1)).first()[0]
        return metrics.topic_rollup(relevant, videos, longest)

    def build_topics() -> DataFrame:
        return metrics.topic_metrics(rollup, videos, metrics.reply_conflict(relevant))

    relevant = store.stage("relevant", build_relevant) if store else stage_table(build_relevant(), "relevant")
    rollup = store.stage("rollup", build_rollup) if store else checkpointed(build_rollup())
    per_topic = store.stage("topics", build_topics) if store else checkpointed(build_topics())
    return {"relevant": relevant, "rollup": rollup, "topics": per_topic}


def priors(posts: DataFrame, studies: DataFrame, rules: Rules = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Topic priors of every post of the studies and candidates for new topics, all studies in one run (clusters never cross studies)."""
    known = studies.select("study_id").distinct()
    return study_clusters.priors_by(posts.join(known, "study_id", "left_semi").select("study_id", "post_seq", "text"), "study_id", "post_seq",
        topics.topic_centroids(posts.sparkSession, rules=rules))


def run(posts: DataFrame, annotations: DataFrame, videos: DataFrame, studies: DataFrame, near: bool = True,
        weights: dict[str, dict[str, float]] | None = None, rules: Rules = DEFAULT, folder: str | None = None) -> dict[str, DataFrame]:
    """All result tables of a run: normalised posts, metrics, rankings, evidence, claims, violations, report.

    With a folder, the costly stages are kept there: a run that was cut off is taken up where it was, and one on changed tables or with
    other parameters is refused (see resume).
    """
    tables = {"posts": posts, "annotations": annotations, "videos": videos, "studies": studies}
    store = Run(folder, tables, {"near": near, "weights": weights, "rules": asdict(rules)}) if folder else None
    # Cleaned once: the report counts all stages, the rest goes on from the rows that stay.
    def build_kept() -> DataFrame:
        return normalize.deduplicated(stages.where("kept"), near).select(*posts.columns, "dedup_group")

    stages = normalize.staged(posts, studies, rules=rules)
    stages = store.stage("staged", lambda: stages) if store else stage_table(stages, "staged")
    kept = store.stage("kept", build_kept) if store else stage_table(build_kept(), "kept")
    out = metric_tables(kept, annotations, videos, studies, store)
    spark = posts.sparkSession
    norm = composite.normalised(composite.components(out["topics"]))
    ranking = composite.ranked(composite.scores(norm, composite.weight_table(spark, weights)))
    prior_rows, candidates = priors(kept, studies, rules)
    labelled = effective.relevant_posts(effective.with_offsets(kept, studies), annotations)
    claims = checkpointed(evidence.claims(out["topics"], ranking, out["relevant"]))
    violations = evidence.verify_claims(claims, rules)
    return {
        **out, "posts": kept, "priors": prior_rows, "new_topics": candidates, "normalise_report": normalize.report(stages, kept), "components": norm, "ranking": ranking,
        "sensitivity": composite.sensitivity(norm, weights), "evidence": evidence.evidence_items(labelled, videos),
        "evidence_index": evidence.representative(out["relevant"]), "claims": claims, "violations": violations,
        "report": evidence.passing_report(claims, violations),
        "dataset": metrics.dataset_counts(kept, annotations, videos, out["rollup"]),
    }
