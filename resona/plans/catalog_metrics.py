"""Queries over topic metrics, composites, evidence, claims and read views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import measures as M
from ..operators import compare, composite, effective, evidence, metrics, views
from .bindings import Tables
from .registry import query


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def q6(*names: str, prefix: str = "") -> str:
    return ", ".join(f"round(CAST({prefix}{n} AS DOUBLE), 6) AS {n}" for n in names)


def _topic_query(name: str, columns: list[str], rounded: list[str]) -> None:
    head = "study_id, topic" + "".join(f", {c}" for c in columns)
    tail = f", {q6(*rounded)}" if rounded else ""

    @query(name, f"SELECT {head}{tail} FROM topics")
    def _(t: Tables, columns=tuple(columns), rounded=tuple(rounded)) -> DataFrame:
        return t.topics.select("study_id", "topic", *columns, *r6(*rounded))


_topic_query("ag02_stance_distribution", ["support", "oppose", "neutral", "mixed", "unclear", "abstain"], [])
_topic_query("ag04_topic_share", ["count", "n_valid"], ["topic_share"])
_topic_query("ag05_net_support", [], ["net_support"])
_topic_query("ag06_support_rate", [], ["support_rate"])
_topic_query("ag07_stance_entropy", [], ["entropy"])
_topic_query("ag09_volume_norm", [], ["volume"])
_topic_query("ag10_controversy", [], ["controversy"])
_topic_query("ag12_trend_speed", [], ["trend_speed"])
_topic_query("ag13_engagement", [], ["engagement"])
_topic_query("ag14_persistence", ["active_days", "video_count", "all_videos"], ["persistence"])
_topic_query("ag16_oppose_intensity", [], ["oppose_intensity"])
_topic_query("ag17_growth", ["launch_n", "ferment_n"], ["growth_delta"])
_topic_query("ag18_ugc_diffusion", [], ["ugc_diffusion"])
_topic_query("ag20_per_base", [], ["per_1000", "per_10_videos"])


@query("ag01_dataset_counts", """
SELECT study_id, total_posts, effective_posts, relevant_posts, videos, abstain_count, irrelevant_count
FROM (SELECT study_id, count(*) AS total_posts FROM posts GROUP BY 1)
JOIN (SELECT study_id, count(*) AS effective_posts FROM effective GROUP BY 1) USING (study_id)
JOIN (SELECT study_id, n_valid AS relevant_posts FROM n_valid) USING (study_id)
JOIN (SELECT study_id, all_videos AS videos FROM video_totals) USING (study_id)
JOIN (SELECT study_id, count(*) FILTER (relevant IS NULL) AS abstain_count,
        count(*) FILTER (NOT relevant) AS irrelevant_count FROM annotations GROUP BY 1) USING (study_id)""")
def ag01(t: Tables) -> DataFrame:
    return metrics.dataset_counts(t.posts, t.annotations, t.videos, t.rollup)


@query("ag03_overall_stance", """
SELECT study_id, count(*) AS n_valid, count(*) FILTER (stance = '支持') AS support,
  count(*) FILTER (stance = '反对') AS oppose, count(*) FILTER (stance = '中立') AS neutral,
  count(*) FILTER (stance = '混合') AS mixed, count(*) FILTER (stance = '不明确') AS unclear,
  count(*) FILTER (stance IS NULL) AS abstain,
  round((count(*) FILTER (stance = '支持') - count(*) FILTER (stance = '反对'))
    / count(*) FILTER (stance IN ('支持', '反对')), 6) AS net_support
FROM relevant GROUP BY 1""")
def ag03(t: Tables) -> DataFrame:
    return metrics.overall(t.rollup).withColumn("net_support", F.round("net_support", 6))


@query("ag08_reply_conflict",
       "SELECT study_id, edges, opposed, round(reply_conflict, 6) AS reply_conflict FROM conflict")
def ag08(t: Tables) -> DataFrame:
    return t.conflict.select("study_id", "edges", "opposed", *r6("reply_conflict"))


@query("ag11_daily_counts", "SELECT study_id, topic, CAST(day_index AS INTEGER) AS day_index, n FROM daily")
def ag11(t: Tables) -> DataFrame:
    return metrics.daily_counts(t.relevant, t.studies).select("study_id", "topic", "day_index", "n")


@query("ag15_video_categories", """
SELECT study_id, topic, video_count, array_to_string(video_categories, ',') AS categories FROM topics""")
def ag15(t: Tables) -> DataFrame:
    return t.topics.select("study_id", "topic", "video_count",
                           F.array_join("video_categories", ",").alias("categories"))


@query("ag19_phase_totals", """
SELECT study_id, topic, count(*) FILTER (phase = 'preheat') AS preheat, count(*) FILTER (phase = 'launch') AS launch,
  count(*) FILTER (phase = 'ferment') AS ferment FROM topic_rows GROUP BY 1, 2""")
def ag19(t: Tables) -> DataFrame:
    return metrics.phase_totals(t.relevant)


@query("ag28_sample_gap", """
SELECT a.n_valid AS a_posts, b.n_valid AS b_posts,
  round(abs(a.n_valid - b.n_valid) / greatest(a.n_valid, b.n_valid, 1), 6) AS sample_gap
FROM n_valid a, n_valid b WHERE a.study_id = 'A' AND b.study_id = 'B'""")
def ag28(t: Tables) -> DataFrame:
    return compare.sample_gap(metrics.overall(t.rollup), "A", "B").select("a_posts", "b_posts", *r6("sample_gap"))


# ---------- composites ----------

def _norm(t: Tables) -> DataFrame:
    return composite.normalised(composite.components(t.stored["topics"]))


def _ranking(t: Tables) -> DataFrame:
    return composite.ranked(composite.scores(_norm(t), composite.weight_table(t.spark)))


def _component_query(name: str, kind: str) -> None:
    @query(name, f"SELECT study_id, topic, component, {q6('raw')} FROM components WHERE kind = '{kind}'")
    def _(t: Tables) -> DataFrame:
        return (composite.components(t.stored["topics"]).where(F.col("kind") == kind)
                .select("study_id", "topic", "component", *r6("raw")))


_component_query("cmp1_issue_components", "issue")
_component_query("cmp2_opportunity_components", "opportunity")


@query("w1_minmax", f"SELECT study_id, topic, kind, component, {q6('value')} FROM norm")
def w1(t: Tables) -> DataFrame:
    return _norm(t).select("study_id", "topic", "kind", "component", *r6("value"))


@query("cmp3_scores", f"SELECT study_id, kind, topic, {q6('score')} FROM scored")
def cmp3(t: Tables) -> DataFrame:
    return _ranking(t).select("study_id", "kind", "topic", *r6("score"))


@query("w2_rank", "SELECT study_id, kind, topic, CAST(rank AS INTEGER) AS rank FROM ranking")
def w2(t: Tables) -> DataFrame:
    return _ranking(t).select("study_id", "kind", "topic", "rank")


_SHIFT_SQL = """
SELECT study_id, kind, scenario, topic, CAST(rank AS INTEGER) AS rank, CAST(base_rank AS INTEGER) AS base_rank,
  CAST(rank_shift AS INTEGER) AS rank_shift FROM shifts"""


@query("cmp4_sensitivity", _SHIFT_SQL)
def cmp4(t: Tables) -> DataFrame:
    return composite.sensitivity(_norm(t)).select(
        "study_id", "kind", "scenario", "topic", "rank", "base_rank", "rank_shift")


@query("cmp5_max_rank_shift", """
SELECT study_id, kind, CAST(max(abs(rank_shift)) AS INTEGER) AS max_rank_shift FROM shifts GROUP BY 1, 2""")
def cmp5(t: Tables) -> DataFrame:
    return composite.max_rank_shift(composite.sensitivity(_norm(t)))


@query("cmp6_custom_weights", f"SELECT study_id, kind, topic, {q6('score')} FROM scored",
       weights="""SELECT * FROM (VALUES ('issue', 'topic_share', 0, CAST(0.7 AS DOUBLE)),
('issue', 'engagement', 1, CAST(0.3 AS DOUBLE)), ('opportunity', 'support_rate', 0, CAST(1.0 AS DOUBLE)))
t(kind, component, ord, weight)""")
def cmp6(t: Tables) -> DataFrame:
    weights = {"issue": {"topic_share": 0.7, "engagement": 0.3}, "opportunity": {"support_rate": 1.0}}
    return composite.scores(_norm(t), composite.weight_table(t.spark, weights)).select(
        "study_id", "kind", "topic", *r6("score"))


@query("udf4_config_tables", f"""
SELECT study_id, kind, scenario, topic, {q6('score')} FROM shifts""")
def udf4(t: Tables) -> DataFrame:
    """Weights and scenarios supplied as tables."""
    return composite.scores(_norm(t), composite.scenario_table(t.spark)).select(
        "study_id", "kind", "scenario", "topic", *r6("score"))


# ---------- evidence and claims ----------

_EVIDENCE_COLUMNS = ["study_id", "evidence_id", "video_id", "video_title", "video_url", "text_excerpt", "likes",
                     "stance", "emotion", "irony", "model_label_stage", "source_url"]


@query("prj15_evidence", f"""
SELECT {', '.join(_EVIDENCE_COLUMNS)}, array_to_string(topics, ',') AS topics,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, {q6('confidence')}, false AS human_modified
FROM evidence""")
def prj15(t: Tables) -> DataFrame:
    return evidence.evidence_items(t.relevant, t.videos).select(
        *_EVIDENCE_COLUMNS, F.array_join("topics", ",").alias("topics"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), *r6("confidence"),
        "human_modified")


@query("w3_representative_evidence", """
SELECT study_id, topic, stance, evidence_id, likes, CAST(rank AS INTEGER) AS rank FROM best""")
def w3(t: Tables) -> DataFrame:
    return evidence.representative(t.relevant).select("study_id", "topic", "stance", "evidence_id", "likes", "rank")


@query("jn17_evidence_lookup", """
SELECT study_id, evidence_id, video_title, text_excerpt FROM evidence
WHERE evidence_id IN (SELECT evidence_id FROM best)""")
def jn17(t: Tables) -> DataFrame:
    """Look up the evidence rows that the topic index cites."""
    items = evidence.evidence_items(t.relevant, t.videos)
    wanted = evidence.representative(t.relevant).select("study_id", "evidence_id").distinct()
    return items.join(wanted, ["study_id", "evidence_id"], "left_semi").select(
        "study_id", "evidence_id", "video_title", "text_excerpt")


def _claims(t: Tables) -> DataFrame:
    return evidence.claims(t.stored["topics"], _ranking(t), t.stored["relevant"])


_CLAIM_CTES = {
    "first_seen": """SELECT study_id, topic, coalesce(stance, '未标注') AS stance, min(post_seq) AS first_seq
FROM topic_rows GROUP BY 1, 2, 3""",
    "cited": """SELECT study_id, topic, list(evidence_id ORDER BY first_seq, rank)[1:3] AS ids
FROM best JOIN first_seen USING (study_id, topic, stance) GROUP BY 1, 2""",
    "claim_rows": """
SELECT r.study_id, kind, rank, CASE kind WHEN 'issue' THEN 'issue-' ELSE 'opp-' END || topic AS claim_id,
  CASE kind WHEN 'issue' THEN '在所采样的 B 站讨论中，『' || topic || '』为本版本重点运营问题方向，净支持率 '
    || coalesce(printf('%+.2f', CAST(round_even(net_support, 2) AS DOUBLE)), '不可用') || '，争议度 '
    || printf('%.2f', CAST(round_even(controversy, 2) AS DOUBLE)) || '，样本 ' || count || ' 条'
  ELSE '在所采样的 B 站讨论中，『' || topic || '』为本版本正向机会方向，支持率 '
    || coalesce(printf('%.0f', CAST(round_even(support_rate * 100, 0) AS DOUBLE)) || '%', '不可用') || '，视频覆盖 '
    || video_count || ' 个，样本 ' || count || ' 条' END
  || CASE WHEN count < 30 THEN '（小样本）' ELSE '' END AS text,
  CASE kind WHEN 'issue' THEN 3 ELSE 2 END AS n_metrics, array_to_string(ids, ',') AS evidence_ids,
  count AS topic_sample_size
FROM ranking r JOIN topics USING (study_id, topic) JOIN cited USING (study_id, topic)
WHERE (kind = 'issue' AND rank <= 3) OR (kind = 'opportunity' AND rank <= 2)""",
}


@query("cl1_claims", """
SELECT study_id, claim_id, text, CAST(n_metrics AS INTEGER) AS n_metrics, evidence_ids, topic_sample_size
FROM claim_rows""", **_CLAIM_CTES)
def cl1(t: Tables) -> DataFrame:
    return _claims(t).select(
        "study_id", "claim_id", "text", F.size("metric_ids").alias("n_metrics"),
        F.array_join("evidence_ids", ",").alias("evidence_ids"), "topic_sample_size")


def _loose_claims(t: Tables) -> DataFrame:
    """Statements written from topic rows, some of which break a rule."""
    w = W.partitionBy("study_id").orderBy("topic_seq")
    n = F.row_number().over(w)
    rows = t.stored["topics"].withColumn("k", n)
    k = F.col("k")
    return rows.select(
        "study_id", F.concat(F.lit("c"), k.cast("string")).alias("claim_id"),
        F.concat("topic", F.when(k % 3 == 0, F.lit(" 所有玩家都反对")).when(k % 3 == 1, F.lit(" 直接造成流失"))
                 .otherwise(F.lit(" 样本讨论"))).alias("text"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("topic")).alias("metric_ids"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("topic")).alias("evidence_ids"),
        (F.col("count") % 60).alias("topic_sample_size"))


_LOOSE_SQL = {
    "loose": """
SELECT study_id, 'c' || k AS claim_id, topic || CASE k % 3 WHEN 0 THEN ' 所有玩家都反对' WHEN 1 THEN ' 直接造成流失'
  ELSE ' 样本讨论' END AS text, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS n_metrics,
  CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS n_evidence, count % 60 AS topic_sample_size
FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY topic_seq) AS k FROM topics)""",
    "broken": """
SELECT study_id, claim_id, 'citation' AS rule, 'metric_id' AS detail FROM loose WHERE n_metrics = 0
UNION ALL SELECT study_id, claim_id, 'citation', 'evidence_id' FROM loose WHERE n_evidence = 0
UNION ALL SELECT study_id, claim_id, 'overreach', p FROM loose,
  (SELECT unnest(['所有玩家', '全体玩家', '所有用户', '全网玩家', '玩家们都', '大家全都']) AS p)
  WHERE regexp_matches(text, p)
UNION ALL SELECT study_id, claim_id, 'causal', p FROM loose,
  (SELECT unnest(['导致', '造成', '致使', '引发了?玩家流失', '直接造成']) AS p) WHERE regexp_matches(text, p)
UNION ALL SELECT study_id, claim_id, 'small_sample', '小样本' FROM loose
  WHERE topic_sample_size < 30 AND NOT contains(text, '小样本')""",
}


@query("cl2_claim_violations", "SELECT * FROM broken", **_LOOSE_SQL)
def cl2(t: Tables) -> DataFrame:
    return evidence.verify_claims(_loose_claims(t))


@query("cl3_report_gate", """
SELECT study_id, claim_id, text FROM claim_rows UNION ALL
SELECT study_id, claim_id, text FROM loose WHERE study_id NOT IN (SELECT study_id FROM broken)""",
       **_CLAIM_CTES, **_LOOSE_SQL)
def cl3(t: Tables) -> DataFrame:
    good, loose = _claims(t), _loose_claims(t)
    passed = evidence.passing_report(good, evidence.verify_claims(good))
    held = evidence.passing_report(loose, evidence.verify_claims(loose))
    return passed.select("study_id", "claim_id", "text").unionByName(held.select("study_id", "claim_id", "text"))


# ---------- joins of the metric stage ----------

@query("jn1_last_annotation", f"""
SELECT study_id, post_id, stance, stage, {q6('confidence')} FROM posts JOIN labels_last USING (study_id, post_id)""")
def jn1(t: Tables) -> DataFrame:
    return t.posts.join(effective.last_annotation(t.annotations), ["study_id", "post_id"]).select(
        "study_id", "post_id", "stance", "stage", *r6("confidence"))


@query("jn2_video_fallback", """
SELECT p.study_id, p.post_id, coalesce(v.title, p.video_id) AS video_title, coalesce(v.url, p.source_url) AS video_url
FROM posts p LEFT JOIN vids v ON v.study_id = p.study_id AND v.video_id = p.video_id""")
def jn2(t: Tables) -> DataFrame:
    return t.posts.join(t.videos.select("study_id", "video_id", "title", "url"), ["study_id", "video_id"], "left").select(
        "study_id", "post_id", F.coalesce("title", "video_id").alias("video_title"),
        F.coalesce("url", "source_url").alias("video_url"))


@query("jn3_reply_edges", """
SELECT study_id, parent_stance, child_stance, count(*) AS n FROM edges GROUP BY 1, 2, 3""")
def jn3(t: Tables) -> DataFrame:
    polar = t.relevant.where(F.col("stance").isin(vocab.SUPPORT, vocab.OPPOSE))
    children = polar.where("parent_id is not null").groupBy(
        "study_id", F.col("parent_id").alias("post_id"), F.col("stance").alias("child_stance")).agg(
        F.count(F.lit(1)).alias("n"))
    parents = polar.select("study_id", "post_id", F.col("stance").alias("parent_stance"))
    return children.join(parents, ["study_id", "post_id"]).groupBy(
        "study_id", "parent_stance", "child_stance").agg(F.sum("n").alias("n"))


@query("jn4_topic_membership", "SELECT study_id, post_id, topic FROM topic_rows")
def jn4(t: Tables) -> DataFrame:
    return metrics.topic_rows(t.relevant).select("study_id", "post_id", "topic")


@query("flt7_relevant_set", "SELECT study_id, post_id, likes FROM relevant")
def flt7(t: Tables) -> DataFrame:
    return t.relevant.select("study_id", "post_id", "likes")


# ---------- comparison of two studies ----------

_COMPARE_FIELDS = ["per_1000", "share", "net_support", "controversy", "per_10_videos", "trend", "count"]
_COMPARE_SQL = """
SELECT topic, round_even(a.per_1000, 1) AS a_per_1000, round(a.topic_share, 6) AS a_share,
  round(a.net_support, 6) AS a_net_support, round(a.controversy, 6) AS a_controversy,
  round_even(a.per_10_videos, 1) AS a_per_10_videos, round(a.trend_speed, 6) AS a_trend,
  CAST(a.count AS DOUBLE) AS a_count, round_even(b.per_1000, 1) AS b_per_1000, round(b.topic_share, 6) AS b_share,
  round(b.net_support, 6) AS b_net_support, round(b.controversy, 6) AS b_controversy,
  round_even(b.per_10_videos, 1) AS b_per_10_videos, round(b.trend_speed, 6) AS b_trend,
  CAST(b.count AS DOUBLE) AS b_count
FROM (SELECT * FROM topics WHERE study_id = 'A') a FULL JOIN (SELECT * FROM topics WHERE study_id = 'B') b USING (topic)"""
_COMPARE_SQL = _COMPARE_SQL.replace("round_even(a.per_1000, 1)", "CAST(round_even(a.per_1000, 1) AS DOUBLE)").replace(
    "round_even(b.per_1000, 1)", "CAST(round_even(b.per_1000, 1) AS DOUBLE)").replace(
    "round_even(a.per_10_videos, 1)", "CAST(round_even(a.per_10_videos, 1) AS DOUBLE)").replace(
    "round_even(b.per_10_videos, 1)", "CAST(round_even(b.per_10_videos, 1) AS DOUBLE)")


def _comparison(t: Tables) -> DataFrame:
    rows = compare.topic_comparison(t.stored["topics"], "A", "B")
    out = [F.col("topic")]
    for side in "ab":
        for f in _COMPARE_FIELDS:
            c = F.col(f"{side}_{f}").cast("double")
            out.append((c if f in ("per_1000", "per_10_videos", "count") else F.round(c, 6)).alias(f"{side}_{f}"))
    return rows.select(*out)


@query("vw7_comparison", _COMPARE_SQL)
def vw7(t: Tables) -> DataFrame:
    return _comparison(t)


@query("jn5_two_study_join", """
SELECT topic, a.count IS NOT NULL AS in_a, b.count IS NOT NULL AS in_b
FROM (SELECT * FROM topics WHERE study_id = 'A') a FULL JOIN (SELECT * FROM topics WHERE study_id = 'B') b USING (topic)""")
def jn5(t: Tables) -> DataFrame:
    return compare.topic_comparison(t.stored["topics"], "A", "B").select(
        "topic", F.col("a_count").isNotNull().alias("in_a"), F.col("b_count").isNotNull().alias("in_b"))


@query("set1_topic_union", "SELECT DISTINCT topic FROM topics")
def set1(t: Tables) -> DataFrame:
    side = metrics.topic_rows(t.relevant)
    return (side.where("study_id = 'A'").select("topic").union(side.where("study_id = 'B'").select("topic"))
            .distinct())


# ---------- read views ----------

@query("vw1_overview", f"""
SELECT study_id, 'topic' AS section, topic, CAST(count AS DOUBLE) AS value,
  CAST(row_number() OVER (PARTITION BY study_id ORDER BY count DESC, topic_seq) AS INTEGER) AS rank FROM topics
UNION ALL SELECT study_id, kind, topic, round(score, 6), CAST(rank AS INTEGER) FROM ranking WHERE rank <= 5""")
def vw1(t: Tables) -> DataFrame:
    return views.overview(t.stored["topics"], _ranking(t)).withColumn("value", F.round("value", 6))


@query("vw2_timeline", """
SELECT study_id, topic, array_to_string(list(n ORDER BY day_index), ',') AS daily_counts,
  round(any_value(trend_speed), 6) AS trend_speed
FROM daily JOIN trend USING (study_id, topic) GROUP BY 1, 2""")
def vw2(t: Tables) -> DataFrame:
    arrays = metrics.daily_arrays(metrics.daily_counts(t.stored["relevant"], t.studies))
    return arrays.join(t.stored["topics"].select("study_id", "topic", "trend_speed"), ["study_id", "topic"]).select(
        "study_id", "topic",
        F.array_join(F.transform("daily_counts", lambda x: x.cast("string")), ",").alias("daily_counts"),
        *r6("trend_speed"))


@query("vw3_top_volume", """
SELECT study_id, topic, total, CAST(volume_rank AS INTEGER) AS volume_rank, CAST(trend_rank AS INTEGER) AS trend_rank
FROM (SELECT study_id, topic, total,
    row_number() OVER (PARTITION BY study_id ORDER BY total DESC, topic_seq) AS volume_rank,
    row_number() OVER (PARTITION BY study_id ORDER BY coalesce(trend_speed, -99) DESC, topic_seq) AS trend_rank
  FROM (SELECT study_id, topic, topic_seq, CAST(sum(n) AS BIGINT) AS total FROM daily GROUP BY 1, 2, 3)
  JOIN trend USING (study_id, topic)) WHERE volume_rank <= 8""")
def vw3(t: Tables) -> DataFrame:
    return views.top_volume(metrics.daily_counts(t.stored["relevant"], t.studies), t.stored["topics"])


@query("vw4_controversy", """
SELECT study_id, topic, round(controversy, 6) AS controversy, round(reply_conflict, 6) AS reply_conflict,
  b.stance, array_to_string(list(b.evidence_id ORDER BY b.rank), ',') AS evidence
FROM (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY controversy DESC, topic_seq) <= 8) c
JOIN best b USING (study_id, topic) GROUP BY 1, 2, 3, 4, 5""")
def vw4(t: Tables) -> DataFrame:
    return views.controversy(t.stored["topics"], evidence.representative(t.stored["relevant"])).select(
        "study_id", "topic", *r6("controversy", "reply_conflict"), "stance",
        F.array_join("evidence", ",").alias("evidence"))


@query("vw5_sensitivity_view", """
SELECT study_id, kind, topic, CAST(max(rank_shift) AS INTEGER) AS up, CAST(min(rank_shift) AS INTEGER) AS down,
  CAST(any_value(base_rank) AS INTEGER) AS base_rank FROM shifts GROUP BY 1, 2, 3""")
def vw5(t: Tables) -> DataFrame:
    return composite.sensitivity(_norm(t)).groupBy("study_id", "kind", "topic").agg(
        F.max("rank_shift").alias("up"), F.min("rank_shift").alias("down"), F.first("base_rank").alias("base_rank"))


@query("vw10_topic_matrix", f"""
SELECT study_id, topic, count, {q6('topic_share', 'net_support', 'controversy', 'trend_speed')},
  CAST(row_number() OVER (PARTITION BY study_id ORDER BY count DESC, topic_seq) AS INTEGER) AS position FROM topics""")
def vw10(t: Tables) -> DataFrame:
    w = W.partitionBy("study_id").orderBy(F.col("count").desc(), "topic_seq")
    return t.topics.select(
        "study_id", "topic", "count", *r6("topic_share", "net_support", "controversy", "trend_speed"),
        F.row_number().over(w).alias("position"))


@query("flt9_net_support_sign", """
SELECT study_id, topic, CASE WHEN coalesce(net_support, 0) > 0 THEN 'positive'
  WHEN coalesce(net_support, 0) < 0 THEN 'negative' END AS side FROM topics WHERE coalesce(net_support, 0) <> 0""")
def flt9(t: Tables) -> DataFrame:
    return views.by_sign(t.stored["topics"], "negative").unionByName(views.by_sign(t.stored["topics"], "positive")).select(
        "study_id", "topic", "side")


@query("flt11_stance_parts", """
SELECT study_id, topic, part, value FROM (UNPIVOT (SELECT * FROM topics) ON support, oppose, neutral, mixed, unclear, abstain
  INTO NAME part VALUE value) WHERE value > 0""")
def flt11(t: Tables) -> DataFrame:
    return views.stance_parts(t.topics).select("study_id", "topic", "part", "value")


@query("flt12_high_conflict", """
SELECT study_id, topic, coalesce(reply_conflict, 0) > 0.3 AS high_conflict FROM topics""")
def flt12(t: Tables) -> DataFrame:
    return t.topics.select("study_id", "topic", (F.coalesce("reply_conflict", F.lit(0.0)) > 0.3).alias("high_conflict"))


@query("entry_issue_ranking", f"""
SELECT study_id, topic, CAST(rank AS INTEGER) AS rank, count, {q6('score', 'topic_share', 'net_support')}
FROM ranking JOIN topics USING (study_id, topic) WHERE kind = 'issue'""")
def issue_ranking(t: Tables) -> DataFrame:
    top = _ranking(t).where("kind = 'issue'").select("study_id", "topic", "rank", "score")
    return top.join(t.stored["topics"], ["study_id", "topic"]).select(
        "study_id", "topic", "rank", "count", *r6("score", "topic_share", "net_support"))
