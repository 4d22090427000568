"""Metric formulas against hand numbers, and a small study from end to end."""

import math

import pytest
from pyspark.sql import functions as F

from resona import vocab
from resona.functions import measures as M
from resona.operators import composite, evidence, metrics, review
from resona.plans import study

S, O, N = vocab.SUPPORT, vocab.OPPOSE, vocab.NEUTRAL


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(*xs):
    return [F.lit(x) for x in xs]


def test_ratios_have_no_value_without_a_base(spark):
    assert value(spark, M.ratio(*lits(120, 4000))) == pytest.approx(0.03)
    assert value(spark, M.ratio(*lits(5, 0))) is None
    assert value(spark, M.net_support(*lits(3, 1))) == pytest.approx(0.5)
    assert value(spark, M.net_support(*lits(0, 0))) is None
    assert value(spark, M.per_thousand(*lits(500, 2500))) == pytest.approx(200)
    assert value(spark, M.per_thousand(*lits(10, 0))) is None
    assert value(spark, M.per_ten(*lits(15, 50))) == pytest.approx(3)


def test_entropy_and_controversy(spark):
    assert value(spark, M.entropy_norm(*lits(25, 25, 25, 25))) == pytest.approx(1.0)
    assert value(spark, M.entropy_norm(*lits(100, 0, 0, 0))) == 0
    assert value(spark, M.entropy_norm(*lits(0, 0, 0, 0))) == 0
    c = M.controversy(F.lit(1.0), F.lit(0.5), M.volume_norm(*lits(1000, 4000)))
    assert value(spark, c) == pytest.approx(0.5 + 0.15 + 0.2 * math.log(1001) / math.log(4001))


def test_trend_speed_needs_only_counts_and_index_sums(spark):
    series = [10] * 9 + [100]
    got = value(spark, M.trend_speed(F.lit(10), F.lit(sum(series)), F.lit(sum(i * y for i, y in enumerate(series)))))
    assert got == pytest.approx(405 / 82.5 / 19)
    assert value(spark, M.trend_speed(F.lit(10), F.lit(50), F.lit(225))) == pytest.approx(0)
    assert value(spark, M.trend_speed(F.lit(10), F.lit(0), F.lit(0))) is None
    assert value(spark, M.trend_speed(F.lit(1), F.lit(1), F.lit(0))) is None


def test_persistence_and_minmax(spark):
    assert value(spark, M.persistence(*lits(18, 36, 10, 40))) == pytest.approx(0.375)
    assert value(spark, M.minmax(*lits(5.0, 0.0, 10.0))) == pytest.approx(0.5)
    assert value(spark, M.minmax(*lits(1.0, 1.0, 1.0))) == 0.5


def test_scenarios_keep_weights_at_one(spark):
    sums = composite.scenario_table(spark).groupBy("kind", "scenario").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 20 and all(r.s == pytest.approx(1.0) for r in sums)


def make_study(spark):
    studies = spark.sql(
        "select 'x' study_id, date'2026-07-01' t0_date, -7 preheat_lo, -1 preheat_hi, 0 launch_lo, 7 launch_hi, "
        "8 ferment_lo, 28 ferment_hi")
    rows = [  # id, video, parent, day, likes, topics, stance, confidence, relevant
        ("p1", "v1", None, 1, 10, ["活动设计"], S, 0.9, True), ("p2", "v1", "p1", 2, 500, ["活动设计", "战斗与玩法"], O, 0.55, True),
        ("p3", "v2", "p1", 3, 50, ["战斗与玩法"], S, 0.9, True), ("p4", "v2", None, 5, 20, ["活动设计"], N, 0.9, True),
        ("p5", "v9", "p2", 8, 5, ["地图与探索", "活动设计"], O, 0.9, True), ("p6", "v1", None, 10, 80, ["战斗与玩法"], O, 0.9, True),
        ("p7", "v1", None, 40, 1, ["活动设计"], S, 0.9, True), ("p8", "v1", None, 4, 1, [], None, 0.1, None)]
    base = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "post_seq long, post_id string, video_id string, parent_id string, day int, "
        "likes long, topics array<string>, stance string, confidence double, relevant boolean").withColumn(
        "study_id", F.lit("x"))
    posts = base.select(
        "study_id", "post_seq", "post_id", "video_id", "parent_id",
        F.concat(F.lit("评论内容各不相同 "), F.expr("repeat(post_id, 5)"), "post_id").alias("text"),
        F.expr("timestamp'2026-07-01' + make_interval(0, 0, 0, day)").alias("published_at"),
        F.expr("date_add(date'2026-07-01', day)").alias("published_date"), "likes", F.lit(0).cast("long").alias("reply_count"),
        F.col("post_id").alias("anon_user_id"), F.array().cast("array<string>").alias("flags"), F.lit("u").alias("source_url"))
    labels = base.select(
        "study_id", "post_id", F.col("post_seq").alias("ann_seq"), "relevant", "topics", "stance",
        F.lit("期待").alias("emotion"), F.lit(2).cast("long").alias("intensity"), F.lit("无").alias("irony"),
        F.lit("提问").alias("intent"), F.lit(None).cast("string").alias("issue_type"), "confidence",
        F.lit("").alias("evidence_span"), F.lit(None).cast("string").alias("abstain_reason"), F.lit("cheap").alias("stage"))
    videos = spark.createDataFrame([("x", "v1", "One", "u1", "official"), ("x", "v2", "Two", "u2", "review")],
                                   "study_id string, video_id string, title string, url string, category string")
    return posts, labels, videos, studies


def test_small_study_from_end_to_end(spark):
    posts, labels, videos, studies = make_study(spark)
    out = study.run(posts, labels, videos, studies, near=False)
    t = {r.topic: r for r in out["topics"].collect()}
    a = t["活动设计"]
    assert (a.n_valid, a["count"], a.support, a.oppose, a.neutral) == (6, 4, 1, 2, 1)
    assert a.topic_share == pytest.approx(4 / 6) and a.net_support == pytest.approx(-1 / 3)
    assert a.video_categories == ["official", "review"] and a.video_count == 3
    assert a.reply_conflict == pytest.approx(1 / 3)  # p2-p1 opposed, p3-p1 and p5-p2 not
    assert a.oppose_intensity == pytest.approx(2 / 4 * 2 / 3)
    assert (a.launch_n, a.ferment_n) == (3, 1) and a.growth_delta == pytest.approx(-0.5)
    d = out["dataset"].first()
    assert (d.total_posts, d.effective_posts, d.relevant_posts, d.abstain_count, d.videos) == (7, 7, 6, 1, 2)
    r = out["normalise_report"].first()
    assert (r.total_in, r.dropped_out_of_window, r.kept) == (8, 1, 7)
    assert out["claims"].count() == 5 and out["violations"].isEmpty() and out["report"].count() == 5
    e = {x.evidence_id: x for x in out["evidence"].collect()}
    assert e["p5"].video_title == "v9" and e["p5"].video_url == "u" and e["p1"].video_title == "One"
    assert {r["rank"] for r in out["ranking"].where("kind = 'issue'").collect()} == {1, 2, 3}


def test_daily_series_is_dense(spark):
    posts, labels, videos, studies = make_study(spark)
    tables = study.metric_tables(posts, labels, videos, studies)
    arrays = {r.topic: r.daily_counts for r in metrics.daily_arrays(
        metrics.daily_counts(tables["relevant"], studies)).collect()}
    assert len(arrays["活动设计"]) == 36 and sum(arrays["活动设计"]) == 4 and arrays["活动设计"][8] == 1


def test_routing_reasons(spark):
    posts, labels, _, _ = make_study(spark)
    rows = {r.post_id: r.reasons for r in review.route(posts, labels).collect()}
    assert "low_confidence" in rows["p2"] and "high_likes" in rows["p2"]
    assert "low_confidence" in rows["p8"]


def test_claim_rules(spark):
    rows = spark.createDataFrame([
        ("x", "ok", "样本讨论", ["m"], ["e"], 40), ("x", "c1", "样本", [], ["e"], 40), ("x", "c2", "所有玩家", ["m"], ["e"], 40),
        ("x", "c3", "导致流失", ["m"], ["e"], 40), ("x", "c4", "n=12", ["m"], ["e"], 12)],
        "study_id string, claim_id string, text string, metric_ids array<string>, evidence_ids array<string>, "
        "topic_sample_size long")
    got = {(r.claim_id, r.rule) for r in evidence.verify_claims(rows).collect()}
    assert got == {("c1", "citation"), ("c2", "overreach"), ("c3", "causal"), ("c4", "small_sample")}
