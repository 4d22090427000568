"""Queries over evaluation, sampling and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import baseline, evaluate, sampling, study_clusters, topics
from ..session import stage_path, stage_table
from . import resume, study
from .bindings import Tables
from .catalog_ingest import GOLD_SQL, gold_rows
from .catalog_metrics import q6, r6
from .registry import query

# ---------- evaluation on document labels ----------

_CLASSES = ["high", "low", "none"]
_PAIR_SQL = {
    "doc_pairs": """
SELECT source AS study_id, doc_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS y_true,
  CASE WHEN doc_id % 10 = 0 THEN NULL WHEN n_chars > 500 THEN 'high' WHEN toxic = 1 THEN 'none' ELSE 'low' END AS y_pred,
  (n_chars % 101) / 100 AS confidence
FROM labels JOIN documents USING (doc_id)""",
    "classes": "SELECT unnest(['high', 'low', 'none']) AS label",
    "class_counts": """
SELECT study_id, label, count(*) FILTER (y_true = label AND y_pred = label) AS tp,
  count(*) FILTER (y_true IS DISTINCT FROM label AND y_pred = label) AS fp,
  count(*) FILTER (y_true = label AND y_pred IS DISTINCT FROM label) AS fn FROM doc_pairs, classes GROUP BY 1, 2""",
    "class_scores": """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM class_counts)""",
}


def _doc_pairs(t: Tables) -> DataFrame:
    return t.raw("labels").join(t.raw("documents").select("doc_id", "source", "n_chars"), "doc_id").select(
        F.col("source").alias("study_id"), "doc_id",
        F.when(F.col("quality") == 1, F.lit("high")).otherwise(F.lit("low")).alias("y_true"),
        F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("n_chars") > 500, F.lit("high"))
        .when(F.col("toxic") == 1, F.lit("none")).otherwise(F.lit("low")).alias("y_pred"),
        ((F.col("n_chars") % 101) / 100).alias("confidence"))


@query("ev1_macro_f1", """
SELECT study_id, round(macro_f1, 6) AS macro_f1, n, abstain, round(abstain / n, 6) AS abstain_rate
FROM (SELECT study_id, avg(f1) AS macro_f1 FROM class_scores GROUP BY 1)
JOIN (SELECT study_id, count(*) AS n, count(*) FILTER (y_pred IS NULL) AS abstain FROM doc_pairs GROUP BY 1) USING (study_id)""",
       **_PAIR_SQL)
def ev1(t: Tables) -> DataFrame:
    return evaluate.macro_f1(_doc_pairs(t), _CLASSES, ["study_id"]).select(
        "study_id", *r6("macro_f1"), "n", "abstain", *r6("abstain_rate"))


@query("ev1_label_scores", f"SELECT study_id, label, tp, fp, fn, {q6('precision', 'recall', 'f1')} FROM class_scores",
       **_PAIR_SQL)
def ev1_labels(t: Tables) -> DataFrame:
    return evaluate.label_scores(_doc_pairs(t), _CLASSES, ["study_id"]).select(
        "study_id", "label", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("ev3_confusion", """
SELECT study_id, a.label AS y_true, b.label AS y_pred, count(*) FILTER (y_true = a.label AND y_pred = b.label) AS n
FROM doc_pairs, classes a, classes b GROUP BY 1, 2, 3""", **_PAIR_SQL)
def ev3(t: Tables) -> DataFrame:
    return evaluate.confusion(_doc_pairs(t), _CLASSES, ["study_id"])


@query("vw11_confusion_cells", """
SELECT study_id, indexof AS row, indexof2 AS col, n FROM (
  SELECT study_id, list_position(['high', 'low', 'none'], a.label) - 1 AS indexof,
    list_position(['high', 'low', 'none'], b.label) - 1 AS indexof2,
    count(*) FILTER (y_true = a.label AND y_pred = b.label) AS n FROM doc_pairs, classes a, classes b GROUP BY 1, 2, 3)""",
       **_PAIR_SQL)
def vw11(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _CLASSES])
    return evaluate.confusion(_doc_pairs(t), _CLASSES, ["study_id"]).select(
        "study_id", (F.array_position(names, F.col("y_true")) - 1).cast("int").alias("row"),
        (F.array_position(names, F.col("y_pred")) - 1).cast("int").alias("col"), "n")


@query("ev4_cohen_kappa", """
SELECT study_id, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa
FROM (SELECT study_id, sum(CASE WHEN y_true IS NOT DISTINCT FROM y_pred THEN 1 ELSE 0 END) / count(*) AS po FROM doc_pairs GROUP BY 1)
JOIN (SELECT study_id, sum(a * b) AS pe FROM (
  SELECT study_id, label, count(*) FILTER (side = 'a') / any_value(n) AS a, count(*) FILTER (side = 'b') / any_value(n) AS b FROM (
    SELECT study_id, 'a' AS side, y_true AS label FROM doc_pairs UNION ALL SELECT study_id, 'b', y_pred FROM doc_pairs)
  JOIN (SELECT study_id, count(*) AS n FROM doc_pairs GROUP BY 1) USING (study_id) GROUP BY 1, 2) GROUP BY 1) USING (study_id)""", **_PAIR_SQL)
def ev4(t: Tables) -> DataFrame:
    """Over all pairs; a withheld prediction is a label of its own."""
    return evaluate.cohen_kappa(_doc_pairs(t), ["study_id"]).select("study_id", *r6("kappa"))


@query("ev5_calibration_error", """
SELECT study_id, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (
  SELECT study_id, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN confidence >= i / 10 THEN 1 ELSE 0 END)) AS bin,
    count(*) AS n, avg(CASE WHEN y_true IS NOT DISTINCT FROM y_pred THEN 1 ELSE 0 END) AS acc, avg(confidence) AS conf
  FROM doc_pairs GROUP BY 1, 2) GROUP BY 1""", **_PAIR_SQL)
def ev5(t: Tables) -> DataFrame:
    rows = _doc_pairs(t).withColumn("correct", F.col("y_true").eqNullSafe(F.col("y_pred")))
    return evaluate.calibration_error(rows, ["study_id"]).select("study_id", *r6("ece"))


# ---------- evaluation against gold ----------

def _gold(t: Tables) -> DataFrame:
    return evaluate.resolve_gold(gold_rows(t))


def _matched(t: Tables) -> DataFrame:
    from ..operators.effective import last_annotation

    return evaluate.matched(last_annotation(t.annotations), _gold(t))


_VOCABULARIES = {"stance": vocab.STANCES, "emotion": vocab.EMOTIONS, "irony": vocab.IRONY}


def _field_f1(field: str, values: list[str]) -> str:
    return f"""
SELECT study_id, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS {field}_f1 FROM (
  SELECT study_id, label, count(*) FILTER (g_{field} = label AND {field} = label) AS tp,
    count(*) FILTER (g_{field} <> label AND {field} = label) AS fp,
    count(*) FILTER (g_{field} = label AND {field} IS DISTINCT FROM label) AS fn
  FROM common, (SELECT unnest({values}) AS label) WHERE g_{field} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


_EVAL_SQL = {
    **GOLD_SQL,
    "common": """
SELECT l.*, g.relevant AS g_relevant, g.stance AS g_stance, g.emotion AS g_emotion, g.irony AS g_irony, g.topics AS g_topics,
  l.relevant IS NOT DISTINCT FROM g.relevant AS correct
FROM labels_last l JOIN gold_final g ON g.study_id = l.study_id AND g.post_id = l.post_id""",
    **{f"f1_{f}": _field_f1(f, v) for f, v in _VOCABULARIES.items()},
    "gold_ece": """
SELECT study_id, sum(n * abs(acc - conf)) / sum(n) AS ece FROM (
  SELECT study_id, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN confidence >= i / 10 THEN 1 ELSE 0 END)) AS bin,
    count(*) AS n, avg(CAST(correct AS INTEGER)) AS acc, avg(confidence) AS conf FROM common GROUP BY 1, 2) GROUP BY 1""",
    "evaluation": """
SELECT a.*, ece, stance_f1, emotion_f1, irony_f1 FROM (SELECT study_id, count(*) AS n,
  avg(CAST(correct AS INTEGER)) AS replay_agreement FROM common GROUP BY 1) a
JOIN gold_ece USING (study_id) JOIN f1_stance USING (study_id) JOIN f1_emotion USING (study_id)
JOIN f1_irony USING (study_id)""",
}


@query("ev2_multilabel_f1", """
SELECT study_id, label, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM (SELECT study_id, label, count(*) FILTER (list_contains(g_topics, label) AND list_contains(p, label)) AS tp,
  count(*) FILTER (NOT list_contains(g_topics, label) AND list_contains(p, label)) AS fp,
  count(*) FILTER (list_contains(g_topics, label) AND NOT list_contains(p, label)) AS fn
  FROM (SELECT *, CASE WHEN intensity = 1 THEN ['活动设计'] ELSE topics END AS p FROM common),
  (SELECT unnest(""" + str(vocab.TOPICS) + """) AS label) GROUP BY 1, 2)""", **_EVAL_SQL)
def ev2(t: Tables) -> DataFrame:
    from ..operators.effective import last_annotation

    predicted = last_annotation(t.annotations).select(
        "study_id", "post_id", F.when(F.col("intensity") == 1, F.array(F.lit("活动设计")))
        .otherwise(F.col("topics")).alias("y_pred"))
    pairs = predicted.join(_gold(t).select("study_id", "post_id", F.col("topics").alias("y_true")), ["study_id", "post_id"])
    return evaluate.multilabel_scores(pairs, vocab.TOPICS, ["study_id"]).select(
        "study_id", "label", "tp", "fp", "fn", *r6("f1"))


@query("ev6_evaluate_run", f"""
SELECT study_id, n, {q6('replay_agreement', 'ece', 'stance_f1', 'emotion_f1', 'irony_f1')} FROM evaluation""", **_EVAL_SQL)
def ev6(t: Tables) -> DataFrame:
    return evaluate.run_summary(_matched(t), _VOCABULARIES).select(
        "study_id", "n", *r6("replay_agreement", "ece", "stance_f1", "emotion_f1", "irony_f1"))


# ---------- vector baseline against gold ----------

def _gold_vectors(t: Tables) -> DataFrame:
    """Posts with a gold row, their vector, and what gold says."""
    texts = t.posts.select("study_id", "post_id", "video_id", "text")
    gold = _gold(t).select("study_id", "post_id", "relevant", F.col("topics").alias("gold_topics"))
    return texts.join(gold, ["study_id", "post_id"]).withColumn("vector", topics.hash_embedding(F.col("text"))).drop("text")


_GRAM_VECTOR = """
SELECT post_id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY post_id)) AS value FROM (
  SELECT post_id, h % 256 AS dim, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS BIGINT) AS c FROM (
    SELECT post_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (
      SELECT post_id, unnest(CASE WHEN len(c) <= 3 THEN [s] ELSE
        list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END) AS g
      FROM (SELECT post_id, s, string_split(s, '') AS c FROM {source}))) GROUP BY 1, 2) WHERE c <> 0"""
_TOPIC_TEXTS = ("SELECT topic AS post_id, regexp_replace(lower(topic || ' ' || d), '\\s+', '', 'g') AS s FROM (VALUES "
                + ", ".join(f"('{k}', '{v}')" for k, v in vocab.TOPIC_TEXT.items()) + ") x(topic, d)")
_BASELINE_SQL = {
    **_EVAL_SQL,
    "gold_posts": """
SELECT p.study_id, p.study_id || '|' || p.post_id AS post_id, p.video_id, regexp_replace(lower(p.text), '\\s+', '', 'g') AS s, g.relevant, g.topics
FROM posts p JOIN gold_final g ON g.study_id = p.study_id AND g.post_id = p.post_id""",
    "topic_texts": _TOPIC_TEXTS,
    "gold_vec": _GRAM_VECTOR.format(source="gold_posts"),
    "topic_vec": _GRAM_VECTOR.format(source="topic_texts"),
    "gold_hits": "SELECT g.post_id, c.post_id AS topic, sum(g.value * c.value) AS similarity FROM gold_vec g JOIN topic_vec c USING (dim) GROUP BY 1, 2",
    "gold_split": """
SELECT study_id, video_id, place <= greatest(CAST(round_even(n * 0.3, 0) AS BIGINT), 1) AS test FROM (
  SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY md5('42|' || video_id)) AS place, count(*) OVER (PARTITION BY study_id) AS n
  FROM (SELECT DISTINCT study_id, video_id FROM gold_posts))""",
    "gold_sims": """
SELECT p.study_id, p.post_id, p.video_id, p.relevant, p.topics, x.post_id AS topic, round(coalesce(h.similarity, 0), 12) AS similarity, test
FROM gold_posts p CROSS JOIN topic_texts x JOIN gold_split USING (study_id, video_id)
LEFT JOIN gold_hits h ON h.post_id = p.post_id AND h.topic = x.post_id""",
    "gold_best": """
SELECT study_id, post_id, any_value(video_id) AS video_id, any_value(relevant) AS relevant, any_value(test) AS test, max(similarity) AS best,
  CASE WHEN len(any_value(topics)) > 0 THEN coalesce(max(similarity) FILTER (list_contains(topics, topic)), 0) END AS gold_best
FROM gold_sims GROUP BY 1, 2""",
    "gold_limits": """
SELECT study_id, coalesce(list(best ORDER BY best) FILTER (relevant)[CAST(floor(count(*) FILTER (relevant) * 0.10) AS BIGINT) + 1], 0.3) AS rel,
  coalesce(list(gold_best ORDER BY gold_best) FILTER (gold_best IS NOT NULL)[CAST(floor(count(gold_best) * 0.25) AS BIGINT) + 1], 0.3) AS top
FROM gold_best WHERE NOT test GROUP BY 1""",
    "rel_pairs": """
SELECT study_id, CASE WHEN relevant THEN 'r' WHEN NOT relevant THEN 'i' ELSE 'a' END AS y, CASE WHEN best >= rel THEN 'r' ELSE 'i' END AS p
FROM gold_best JOIN gold_limits USING (study_id) WHERE test""",
    "rel_f1": """
SELECT study_id, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS relevance_f1 FROM (
  SELECT study_id, l, count(*) FILTER (y = l AND p = l) AS tp, count(*) FILTER (y <> l AND p = l) AS fp, count(*) FILTER (y = l AND p <> l) AS fn
  FROM rel_pairs, (SELECT unnest(['r', 'i']) AS l) GROUP BY 1, 2) GROUP BY 1""",
    "top_pairs": """
SELECT study_id, post_id, any_value(topics) AS y,
  coalesce(list(topic ORDER BY similarity DESC, topic DESC) FILTER (round(similarity, 12) >= round(top, 12))[1:4], []) AS p
FROM gold_sims JOIN gold_limits USING (study_id) WHERE test GROUP BY 1, 2""",
    "top_f1": """
SELECT study_id, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS topics_f1 FROM (
  SELECT study_id, l, count(*) FILTER (list_contains(y, l) AND list_contains(p, l)) AS tp,
    count(*) FILTER (NOT list_contains(y, l) AND list_contains(p, l)) AS fp, count(*) FILTER (list_contains(y, l) AND NOT list_contains(p, l)) AS fn
  FROM top_pairs, (SELECT unnest(""" + str(vocab.TOPICS) + """) AS l) GROUP BY 1, 2) GROUP BY 1""",
    "baseline": """
SELECT study_id, relevance_f1, topics_f1, rel AS relevance_threshold, top AS topics_threshold, train, test, train_videos, test_videos
FROM gold_limits JOIN rel_f1 USING (study_id) JOIN top_f1 USING (study_id) JOIN (
  SELECT study_id, count(*) FILTER (NOT test) AS train, count(DISTINCT video_id) FILTER (NOT test) AS train_videos,
    count(DISTINCT video_id) FILTER (test) AS test_videos, count(*) FILTER (test) AS test FROM gold_best GROUP BY 1) USING (study_id)""",
}
_BASELINE_COLUMNS = ("relevance_f1", "topics_f1", "relevance_threshold", "topics_threshold")


@query("vec8_baseline_scores", f"SELECT study_id, {q6(*_BASELINE_COLUMNS)}, train, test, train_videos, test_videos FROM baseline", **_BASELINE_SQL)
def vec8_scores(t: Tables) -> DataFrame:
    """Relevance and topic scores of the vector baseline on the posts with gold."""
    return baseline.vector_baseline(_gold_vectors(t), topics.topic_centroids(t.spark)).select(
        "study_id", *r6(*_BASELINE_COLUMNS), "train", "test", "train_videos", "test_videos")


def _summary(t: Tables) -> tuple[DataFrame, DataFrame]:
    return (evaluate.run_summary(_matched(t), _VOCABULARIES),
            baseline.vector_baseline(_gold_vectors(t), topics.topic_centroids(t.spark)))


_TARGET_SQL = """
SELECT study_id, measure, round(value, 6) AS value, CAST(target AS DOUBLE) AS target, value >= target AS met FROM (
  SELECT study_id, unnest(['relevance', 'topics', 'stance', 'emotion', 'irony']) AS measure,
    unnest([relevance_f1, topics_f1, stance_f1, emotion_f1, irony_f1]) AS value,
    unnest([0.90, 0.70, 0.75, 0.65, 0.60]) AS target FROM evaluation JOIN baseline USING (study_id))"""


@query("vw6_evaluation_view", _TARGET_SQL, **_BASELINE_SQL)
def vw6(t: Tables) -> DataFrame:
    summary, scores = _summary(t)
    joined = summary.join(scores.select("study_id", "relevance_f1", "topics_f1"), "study_id")
    return evaluate.against_targets(joined, vocab.TARGETS).select("study_id", "measure", *r6("value"), "target", "met")


@query("ev8_evaluation_record", f"""
SELECT study_id, test AS n_evaluated, n_gold, {q6('relevance_f1', 'topics_f1', 'ece', 'stance_f1', 'irony_f1')},
  round(n_posts / (n_posts / 50.0) * 60, 1) AS per_minute FROM evaluation JOIN baseline USING (study_id)
JOIN (SELECT study_id, count(*) AS n_gold FROM gold_final GROUP BY 1) USING (study_id)
JOIN (SELECT study_id, count(*) AS n_posts FROM posts GROUP BY 1) USING (study_id)""", **_BASELINE_SQL)
def ev8(t: Tables) -> DataFrame:
    summary, scores = _summary(t)
    seconds = t.posts.groupBy("study_id").agg(F.count(F.lit(1)).alias("posts"), (F.count(F.lit(1)) / 50).alias("duration_s"))
    return evaluate.record(summary, scores, _gold(t), seconds).select(
        "study_id", "n_evaluated", "n_gold", *r6("relevance_f1", "topics_f1", "ece", "stance_f1", "irony_f1"), "per_minute")


@query("jn7_prediction_gold", "SELECT study_id, post_id, stance, g_stance AS gold_stance, correct FROM common", **_EVAL_SQL)
def jn7(t: Tables) -> DataFrame:
    return _matched(t).select("study_id", "post_id", "stance", "gold_stance", "correct")


@query("ev7_gold_layers", "SELECT study_id, annotator_type, count(*) AS n FROM gold GROUP BY 1, 2", **GOLD_SQL)
def ev7(t: Tables) -> DataFrame:
    return gold_rows(t).groupBy("study_id", "annotator_type").agg(F.count(F.lit(1)).alias("n"))


@query("w12_gold_layer", "SELECT study_id, post_id, annotator, stance FROM gold_final", **GOLD_SQL)
def w12(t: Tables) -> DataFrame:
    return _gold(t).select("study_id", "post_id", "annotator", "stance")


_DOUBLE_SQL = {**GOLD_SQL, "doubles": """
SELECT a.study_id, a.post_id, a.stance AS y_true, b.stance AS y_pred
FROM (SELECT * FROM gold WHERE annotator = 'ann') a JOIN (SELECT * FROM gold WHERE annotator = 'bob') b
USING (study_id, post_id)"""}


@query("jn8_double_annotated", "SELECT study_id, post_id, y_true, y_pred FROM doubles", **_DOUBLE_SQL)
def jn8(t: Tables) -> DataFrame:
    return evaluate.double_annotated(gold_rows(t), "stance")


@query("set2_common_posts", """
SELECT study_id, post_id FROM gold WHERE annotator = 'ann' INTERSECT SELECT study_id, post_id FROM gold WHERE annotator = 'seed'""",
       **GOLD_SQL)
def set2(t: Tables) -> DataFrame:
    g = gold_rows(t)
    return g.where("annotator = 'ann'").select("study_id", "post_id").intersect(
        g.where("annotator = 'seed'").select("study_id", "post_id"))


# ---------- sampling ----------

@query("ag21_quota_checks", """
SELECT study_id, "check", round(value, 6) AS value, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, passed FROM (
  SELECT study_id, 'videos' AS "check", all_videos AS value, videos_lo AS lo, videos_hi AS hi,
    all_videos BETWEEN videos_lo AND videos_hi AS passed FROM studies JOIN video_totals USING (study_id)
  UNION ALL SELECT study_id, 'category_' || c, n, min_per_category, NULL, n >= min_per_category FROM (
    SELECT g.study_id, c, min_per_category, count(video_id) AS n
    FROM (SELECT s.study_id, min_per_category, unnest(['official', 'guide', 'review', 'fanwork', 'controversy']) AS c
          FROM studies s WHERE study_id IN ('A', 'B')) g
    LEFT JOIN vids v ON v.study_id = g.study_id AND v.category = g.c GROUP BY 1, 2, 3)
  UNION ALL SELECT study_id, 'effective_posts', n, comments_lo, comments_hi, n BETWEEN comments_lo AND comments_hi
    FROM (SELECT study_id, count(*) AS n FROM effective GROUP BY 1) JOIN studies USING (study_id)
  UNION ALL SELECT study_id, 'video_share', share, NULL, max_share, share <= max_share + 1e-9
    FROM (SELECT study_id, max(n) / sum(n) AS share FROM (SELECT study_id, video_id, count(*) AS n FROM effective GROUP BY 1, 2)
          GROUP BY 1) JOIN studies USING (study_id)
  UNION ALL SELECT study_id, 'window_purity', avg(CAST(in_window AS INTEGER)), 0.95, NULL,
    avg(CAST(in_window AS INTEGER)) >= 0.95 FROM dated GROUP BY 1
  UNION ALL SELECT study_id, 'author_max', max(n), NULL, 10, max(n) <= 10
    FROM (SELECT study_id, anon_user_id, count(*) AS n FROM effective GROUP BY 1, 2) GROUP BY 1)""")
def ag21(t: Tables) -> DataFrame:
    return sampling.quota_checks(t.dated_posts, t.videos, t.studies).select(
        "study_id", "check", *r6("value"), "lo", "hi", "passed")


@query("ag22_sample_profile", """
SELECT study_id, posts, sub_replies, CAST(max_share AS DOUBLE) AS max_single_video_share, all_videos AS videos,
  n_official AS official, n_guide AS guide
FROM (SELECT study_id, CAST(sum(n) AS BIGINT) AS posts, CAST(sum(subs) AS BIGINT) AS sub_replies,
  round_even(max(n) / sum(n), 4) AS max_share FROM (
  SELECT study_id, video_id, count(*) AS n, count(parent_id) AS subs FROM posts GROUP BY 1, 2) GROUP BY 1)
JOIN video_totals USING (study_id)
JOIN (SELECT study_id, count(*) FILTER (category = 'official') AS n_official, count(*) FILTER (category = 'guide') AS n_guide
  FROM vids GROUP BY 1) USING (study_id)""")
def ag22(t: Tables) -> DataFrame:
    return sampling.profile(t.posts, t.videos).select(
        "study_id", "posts", "sub_replies", "max_single_video_share", "videos", "official", "guide")


@query("ag23_fingerprint")
def ag23(t: Tables) -> DataFrame:
    """Digest per table; the same rows in another order give the same digest (see the tests)."""
    return sampling.fingerprint({"posts": t.posts, "videos": t.videos, "studies": t.studies})


@query("ag23_resumed_run", """
SELECT 'first' AS attempt, 'relevant' AS stage, 'built' AS outcome, count(*) AS n FROM relevant UNION ALL
SELECT 'first', 'topics', 'built', count(*) FROM topic_base UNION ALL
SELECT 'cut off', 'relevant', 'reused', count(*) FROM relevant UNION ALL
SELECT 'cut off', 'topics', 'built', count(*) FROM topic_base UNION ALL
SELECT 'again', 'relevant', 'reused', count(*) FROM relevant UNION ALL
SELECT 'again', 'topics', 'reused', count(*) FROM topic_base UNION ALL
SELECT 'one like more', 'inputs', 'refused: posts', 0 UNION ALL
SELECT 'other weights', 'inputs', 'refused: parameters', 0""")
def ag23_resumed(t: Tables) -> DataFrame:
    """A run, the same cut off before its topics were entered, once more, then with a changed row and with other parameters."""
    folder = stage_path(t.spark, "run")
    tables = {"posts": t.posts, "videos": t.videos, "annotations": t.annotations, "studies": t.studies}
    out = []

    def attempt(name: str) -> None:
        run = resume.Run(folder, tables, {"weights": "default"})
        made = study.metric_tables(t.posts, t.annotations, t.videos, t.studies, run)
        out.extend(made[s].agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("attempt"), F.lit(s).alias("stage"), F.lit(run.outcomes[s]).alias("outcome"), "n") for s in ("relevant", "topics"))

    attempt("first")
    resume.forget(t.spark, folder, "topics")
    attempt("cut off")
    attempt("again")
    first = t.posts.agg(F.min("post_seq")).first()[0]
    more = t.posts.withColumn("likes", F.col("likes") + F.when(F.col("post_seq") == first, 1).otherwise(0))
    for name, changed, weights in (("one like more", {**tables, "posts": more}, "default"), ("other weights", tables, "other")):
        try:
            resume.Run(folder, changed, {"weights": weights})
            outcome = "accepted"
        except resume.ChangedDataset as e:
            outcome = "refused: " + ", ".join(e.tables)
        except resume.ChangedParameters:
            outcome = "refused: parameters"
        out.append(t.spark.range(1).select(
            F.lit(name).alias("attempt"), F.lit("inputs").alias("stage"), F.lit(outcome).alias("outcome"), F.lit(0).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, out)


@query("ag25_import_statistics", """
SELECT study_id, count(*) FILTER (length(text) < 10) AS short, count(*) FILTER (length(text) BETWEEN 10 AND 49) AS medium,
  count(*) FILTER (length(text) >= 50) AS long, any_value(m) AS max_per_author,
  strftime(min(published_date), '%Y-%m-%d') AS first_day, strftime(max(published_date), '%Y-%m-%d') AS last_day
FROM text_posts JOIN (SELECT study_id, max(n) AS m FROM (SELECT study_id, anon_user_id, count(*) AS n FROM text_posts
  GROUP BY 1, 2) GROUP BY 1) USING (study_id) GROUP BY 1""")
def ag25(t: Tables) -> DataFrame:
    day = "yyyy-MM-dd"
    return sampling.import_statistics(t.text_posts).select(
        "study_id", "short", "medium", "long", "max_per_author", F.date_format("first_day", day).alias("first_day"),
        F.date_format("last_day", day).alias("last_day"))


@query("w7_grouped_split", """
SELECT study_id, video_id, CASE WHEN place <= greatest(CAST(round_even(n * 0.3, 0) AS BIGINT), 1) THEN 'test' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY md5('42|' || video_id)) AS place,
  count(*) OVER (PARTITION BY study_id) AS n FROM (SELECT DISTINCT study_id, video_id FROM posts))""")
def w7(t: Tables) -> DataFrame:
    return sampling.grouped_split(t.posts, "video_id")


@query("w8_stratified_sample")
def w8(t: Tables) -> DataFrame:
    """Capped sample per study (checked against a sequential pass in the tests)."""
    return sampling.stratified_sample(t.dated_posts.where("in_window")).select("study_id", "post_id", "video_id")


@query("prj18_sample_rows", """
SELECT post_id, video_id, parent_id, text, likes, CAST(day_offset AS INTEGER) AS day_offset FROM dated
WHERE in_window AND ('0x' || substr(md5('sample|' || study_id || '|' || post_id), 1, 8))::BIGINT % 10000 < 1000""")
def prj18(t: Tables) -> DataFrame:
    from ..functions.text import hash_fraction

    drawn = hash_fraction("sample", F.col("study_id"), F.col("post_id")) < 1000
    return t.dated_posts.where(F.col("in_window") & drawn).select(
        "post_id", "video_id", "parent_id", "text", "likes", "day_offset")


_T0 = "1998-06-01"
_HIT_SQL = {
    "hits": """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'official' WHEN '2-HIGH' THEN 'guide' WHEN '3-MEDIUM' THEN 'review'
  WHEN '4-NOT SPECIFIED' THEN 'fanwork' ELSE 'controversy' END AS category, 'b' || o_custkey AS video_id,
  CAST(o_orderdate AS DATE) AS pub_date, CAST(floor(o_totalprice) AS BIGINT) AS play, o_orderkey AS seq,
  o_orderstatus AS term, o_custkey % 40 = 0 AS is_official FROM orders""",
    "candidates": f"""
SELECT * FROM hits WHERE pub_date BETWEEN DATE '{_T0}' - 10 AND DATE '{_T0}' + 40
QUALIFY row_number() OVER (PARTITION BY category, video_id ORDER BY seq) = 1""",
    "selection": """
SELECT *, row_number() OVER (PARTITION BY category ORDER BY play DESC, seq) AS place FROM (
  SELECT *, count(*) FILTER (is_official = (category = 'official')) OVER (PARTITION BY category) AS n_fit FROM candidates)
WHERE is_official = (category = 'official') OR n_fit < 6 QUALIFY place <= 10""",
}


def _hits(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    names = {"1-URGENT": "official", "2-HIGH": "guide", "3-MEDIUM": "review", "4-NOT SPECIFIED": "fanwork"}
    category = F.coalesce(*[F.when(p == k, F.lit(v)) for k, v in names.items()], F.lit("controversy"))
    return t.raw("orders").select(
        category.alias("category"), F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("video_id"),
        F.to_date("o_orderdate").alias("pub_date"), F.floor("o_totalprice").alias("play"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("term"), (F.col("o_custkey") % 40 == 0).alias("is_official"))


@query("flt10_window_candidates", "SELECT category, video_id, seq FROM candidates", **_HIT_SQL)
def flt10(t: Tables) -> DataFrame:
    return sampling.window_candidates(_hits(t), _T0).select("category", "video_id", "seq")


@query("w9_video_selection", """
SELECT category, video_id, play, CAST(place AS INTEGER) AS place, n_fit < 6 AS relaxed,
  '类别[' || category || '] 检索词『' || term || '』结果，播放 ' || play || '，发布 ' || strftime(pub_date, '%Y-%m-%d') AS sampling_reason
FROM selection""", **_HIT_SQL)
def w9(t: Tables) -> DataFrame:
    return sampling.select_videos(sampling.window_candidates(_hits(t), _T0)).select(
        "category", "video_id", "play", "place", "relaxed", "sampling_reason")


@query("w10_merge_selection", """
SELECT video_id, category, added, seq % 3 = 0 AS done FROM (
  SELECT video_id, category, seq, 0 AS added FROM picks WHERE seq % 2 = 0 UNION ALL
  SELECT video_id, 'new', seq, 1 FROM picks WHERE seq % 2 = 1)""",
       picks="SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY seq) = 1", **_HIT_SQL)
def w10(t: Tables) -> DataFrame:
    from ..operators.normalize import keep_first_id

    picks = keep_first_id(sampling.window_candidates(_hits(t), _T0), ["video_id"], "seq").select("video_id", "category", "seq")
    old = picks.where("seq % 2 = 0")
    new = picks.withColumn("category", F.lit("new"))
    done = picks.where("seq % 3 = 0").select("video_id")
    return sampling.merge_selection(old, new, done).orderBy("done", "video_id").select(
        "video_id", "category", "added", "done")


# ---------- vectors ----------

_HASH_SQL = {
    "vec_texts": """
SELECT post_id, regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') AS s
FROM (SELECT post_id, text FROM text_posts UNION ALL SELECT 's' || post_id, substr(text, 1, CAST(post_seq % 4 + 1 AS INTEGER)) FROM text_posts)""",
    "topic_texts": "SELECT topic AS post_id, regexp_replace(lower(topic || ' ' || d), '\\s+', '', 'g') AS s FROM (VALUES "
                   + ", ".join(f"('{k}', '{v}')" for k, v in vocab.TOPIC_TEXT.items()) + ") x(topic, d)",
    **{f"{name}_vec": f"""
SELECT post_id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY post_id)) AS value FROM (
  SELECT post_id, h % 256 AS dim, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS BIGINT) AS c FROM (
    SELECT post_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (
      SELECT post_id, unnest(CASE WHEN len(c) <= 3 THEN [s] ELSE
        list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END) AS g
      FROM (SELECT post_id, s, string_split(s, '') AS c FROM {source}))) GROUP BY 1, 2) WHERE c <> 0"""
       for name, source in (("text", "vec_texts"), ("topic", "topic_texts"))},
    "text_sims": """
SELECT p.post_id, x.post_id AS topic, coalesce(s.similarity, 0) AS similarity
FROM vec_texts p CROSS JOIN topic_texts x LEFT JOIN (
  SELECT t.post_id, c.post_id AS topic, sum(t.value * c.value) AS similarity FROM text_vec t JOIN topic_vec c USING (dim) GROUP BY 1, 2) s
ON s.post_id = p.post_id AND s.topic = x.post_id""",
}


def _embedded_texts(t: Tables) -> DataFrame:
    """The texts, and the first one to four characters of each as short comments."""
    rows = t.text_posts.select("post_id", "text", "post_seq")
    short = rows.select(F.concat(F.lit("s"), "post_id").alias("post_id"), F.substring("text", F.lit(1), (F.col("post_seq") % 4 + 1).cast("int")).alias("text"))
    return rows.select("post_id", "text").unionByName(short)


@query("vec1_hash_embedding", f"SELECT post_id, CAST(dim AS INTEGER) AS dim, {q6('value')} FROM text_vec", **_HASH_SQL)
def vec1(t: Tables) -> DataFrame:
    return topics.hash_vectors(_embedded_texts(t), ["post_id"]).select("post_id", "dim", *r6("value"))


def _text_vectors(t: Tables) -> DataFrame:
    return _embedded_texts(t).select("post_id", topics.hash_embedding(F.col("text")).alias("vector"))


def _text_similarities(t: Tables) -> DataFrame:
    """Every text with every topic, the short ones too that share no dimension with it."""
    return topics.dense_similarity(_text_vectors(t), topics.topic_centroids(t.spark), ["post_id"])


@query("vec3_topic_centroids", f"""
SELECT topic, round(sum(similarity), 3) AS total FROM text_sims GROUP BY 1""", **_HASH_SQL)
def vec3(t: Tables) -> DataFrame:
    """Total similarity of all texts with each topic centroid."""
    return _text_similarities(t).groupBy("topic").agg(F.round(F.sum("similarity"), 3).alias("total"))


@query("jn16_centroid_scores", f"SELECT post_id, topic, {q6('similarity')} FROM text_sims", **_HASH_SQL)
def jn16(t: Tables) -> DataFrame:
    return _text_similarities(t).select("post_id", "topic", *r6("similarity"))


@query("vec5_assign_topics", """
SELECT post_id, coalesce(array_to_string(list(topic ORDER BY round(similarity, 12) DESC, topic DESC)
  FILTER (round(similarity, 12) >= 0.05)[1:4], ','), '') AS topics FROM text_sims GROUP BY 1""", **_HASH_SQL)
def vec5(t: Tables) -> DataFrame:
    sims = topics.similarity_lists(_text_vectors(t), topics.topic_centroids(t.spark), ["post_id"])
    return topics.assign(sims, ["post_id"], 0.05).select("post_id", F.array_join("topics", ",").alias("topics"))


_EMB_SQL = {
    "centroids": """
SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2)
GROUP BY 1""",
    "emb_sims": """
SELECT 'E' AS study_id, vec_id, e.label, 't' || c.label AS topic, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.c) AS similarity
FROM embeddings e, centroids c""",
    "emb_split": """
SELECT g, CASE WHEN row_number() OVER (ORDER BY md5('42|' || g)) <= CAST(round_even((SELECT count(DISTINCT vec_id % 20) FROM embeddings)
  * 0.3, 0) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM (SELECT DISTINCT vec_id % 20 AS g FROM embeddings)""",
    "emb_rows": """
SELECT vec_id, any_value(label) AS label, any_value(label) < 5 AS relevant, max(similarity) AS best,
  max(similarity) FILTER (topic = 't' || label) AS gold_best, any_value(part) AS part
FROM emb_sims JOIN emb_split ON g = vec_id % 20 GROUP BY 1""",
    "emb_limits": """
SELECT (SELECT list(best ORDER BY best)[CAST(floor(count(*) * 0.10) AS BIGINT) + 1] FROM emb_rows WHERE part = 'train' AND relevant) AS rel,
  (SELECT list(gold_best ORDER BY gold_best)[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] FROM emb_rows WHERE part = 'train') AS top""",
}


def _emb_vectors(t: Tables) -> DataFrame:
    label = F.concat(F.lit("t"), F.col("label").cast("string"))
    return t.vectors.select(
        F.lit("E").alias("study_id"), "vec_id", label.alias("topic"), "vector", (F.col("label") < 5).alias("relevant"),
        F.array(label).alias("gold_topics"), (F.col("vec_id") % 20).alias("video_id"))


def _emb_sims(t: Tables, key: list[str]) -> DataFrame:
    vectors = _emb_vectors(t)
    return topics.dense_similarity(vectors.drop("topic"), topics.mean_centroids(vectors, "topic"), key)


@query("vec4_cosine", f"SELECT vec_id, topic, {q6('similarity')} FROM emb_sims", **_EMB_SQL)
def vec4(t: Tables) -> DataFrame:
    return _emb_sims(t, ["vec_id"]).select("vec_id", "topic", *r6("similarity"))


@query("vec2_given_vectors", """
SELECT vec_id, len(embedding) AS dim, 'given' AS embed_quality, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""")
def vec2(t: Tables) -> DataFrame:
    return t.vectors.select("vec_id", F.size("vector").cast("long").alias("dim"), F.lit("given").alias("embed_quality"),
                            F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _length_model(texts):
    return [[float(len(x)), float(x.count("e"))] for x in texts]


@query("udf1_embedding_function", """
SELECT post_id, CAST(length(text) AS DOUBLE) AS x0, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS x1,
  'user' AS embed_quality FROM text_posts""")
def udf1(t: Tables) -> DataFrame:
    out = topics.embed_with(t.text_posts, ["post_id"], _length_model, "user")
    return out.select("post_id", F.col("vector")[0].alias("x0"), F.col("vector")[1].alias("x1"), "embed_quality")


@query("vec6_kmeans")
def vec6(t: Tables) -> DataFrame:
    """Cosine k-means over all vectors (checked against a sequential loop in the tests)."""
    labelled, _ = topics.kmeans(t.vectors, "vec_id", topics.cluster_count(t.vectors.count()))
    return labelled.select("vec_id", "cluster")


@query("vec7_emerging_topics")
def vec7(t: Tables) -> DataFrame:
    """Clusters of the vectors that no centroid fits, named new:c0, new:c1, ..."""
    sims = _emb_sims(t, ["vec_id"])
    unfit = sims.groupBy("vec_id").agg(F.max("similarity").alias("best")).where("best < 0.5").select("vec_id")
    # Both are read several times.
    rest = stage_table(t.vectors.join(unfit, "vec_id", "left_semi").withColumn("text", F.concat(F.lit("vector "), F.col("vec_id"))), "unfit")
    labelled = stage_table(topics.kmeans(rest, "vec_id", topics.cluster_count(rest.count()))[0].drop("vector"), "clustered")
    return topics.emerging(labelled, "vec_id", "text").select(
        "new_topic_id", "size", F.array_join("sample_texts", "|").alias("sample_texts"))


@query("vec7_priors")
def vec7_priors(t: Tables) -> DataFrame:
    """The priors stage over whole texts: topics or the new topic of every post (properties are checked in the tests)."""
    rows, _ = topics.priors(t.text_posts.select("post_seq", "text"), "post_seq", threshold=0.3)
    return rows.select("post_seq", F.array_join("topics", ",").alias("topics"), "new_topic")


@query("vec7_study_priors")
def vec7_study_priors(t: Tables) -> DataFrame:
    """The priors stage of many studies in one run: every source of documents is a study."""
    texts = t.text_posts.select(F.col("video_id").alias("study_id"), "post_seq", "text")
    rows, _ = study_clusters.priors_by(texts, "study_id", "post_seq", threshold=0.3)
    return rows.select("study_id", "post_seq", F.array_join("topics", ",").alias("topics"), "new_topic")


def _baseline(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = ["study_id", "vec_id", "relevant", "gold_topics", "video_id"]
    sims = _emb_sims(t, key)
    rows = topics.baseline_rows(sims, key).join(
        sampling.grouped_split(_emb_vectors(t), "video_id"), ["study_id", "video_id"])
    limits = topics.baseline_thresholds(rows.where("part = 'train'"))
    return rows, limits


@query("w5_similarity_thresholds", "SELECT round(rel, 6) AS relevance, round(top, 6) AS topics FROM emb_limits", **_EMB_SQL)
def w5(t: Tables) -> DataFrame:
    return _baseline(t)[1].select(*r6("relevance", "topics"))


@query("vec8_relevance_baseline", """
SELECT vec_id, relevant, best >= rel AS predicted FROM emb_rows, emb_limits WHERE part = 'test'""", **_EMB_SQL)
def vec8(t: Tables) -> DataFrame:
    rows, limits = _baseline(t)
    test = rows.where("part = 'test'").join(limits.withColumnRenamed("relevance", "limit"), "study_id")
    return test.select("vec_id", "relevant", (F.col("best") >= F.col("limit")).alias("predicted"))


@query("vec9_topic_baseline", """
SELECT vec_id, coalesce(array_to_string(list(topic ORDER BY round(similarity, 12) DESC, topic DESC) FILTER (round(similarity, 12) >= round(top, 12))[1:4], ','), '')
  AS topics FROM emb_sims JOIN emb_rows USING (vec_id), emb_limits WHERE part = 'test' GROUP BY 1""", **_EMB_SQL)
def vec9(t: Tables) -> DataFrame:
    rows, limits = _baseline(t)
    test = _emb_sims(t, ["study_id", "vec_id"]).join(
        rows.where("part = 'test'").select("study_id", "vec_id"), ["study_id", "vec_id"], "left_semi")
    limited = test.join(limits.select("study_id", F.col("topics").alias("limit")), "study_id")
    return topics.assign(limited, ["vec_id"], F.col("limit")).select("vec_id", F.array_join("topics", ",").alias("topics"))
