"""Canonical tables derived from the parquet tables of a scale-factor folder.

Tables offers them as lazy DataFrames; SQL holds the same derivations as named ANSI-SQL
table expressions, so that a query can be compared with an independent engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..operators import effective, metrics
from . import study

STUDY_ROWS = """
('A', DATE'2024-01-08', -7, -1, 0, 7, 8, 28, 10, 60, 6, 3000, 5000, CAST(0.10 AS DOUBLE)),
('B', DATE'2024-01-12', -7, -1, 0, 7, 8, 28, 10, 60, 3, 3000, 5000, CAST(0.10 AS DOUBLE)),
('D', DATE'2024-01-10', -7, -1, 0, 7, 8, 28, 10, 60, 3, 3000, 5000, CAST(0.10 AS DOUBLE))
"""
STUDY_COLUMNS = (
    "study_id, t0_date, preheat_lo, preheat_hi, launch_lo, launch_hi, ferment_lo, ferment_hi, "
    "videos_lo, videos_hi, min_per_category, comments_lo, comments_hi, max_share"
)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are costly to process, over all cores even when it is one small file."""
        df, cores = self.raw(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def studies(self) -> DataFrame:
        return self.spark.sql(f"select * from values {STUDY_ROWS} as t({STUDY_COLUMNS})")

    @cached_property
    def posts(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        return self.raw("events").select(
            F.when(u % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("study_id"),
            e.alias("post_seq"), e.cast("string").alias("post_id"),
            F.concat(F.lit("v"), (u % 40).cast("string")).alias("video_id"),
            F.when((e % 4 == 0) & (e >= 7), (e - 7).cast("string")).alias("parent_id"),
            F.concat("event_type", F.lit(" "), "props").alias("text"),
            F.col("ts").cast("timestamp").alias("published_at"), F.to_date("ts").alias("published_date"),
            F.floor("value").cast("long").alias("likes"), (e % 7).alias("reply_count"),
            u.cast("string").alias("anon_user_id"),
            F.when(e % 29 == 0, F.array(F.lit("lottery"))).when(e % 31 == 0, F.array(F.lit("ad")))
            .when(e % 41 == 0, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")).alias("flags"),
            F.concat(F.lit("https://example.org/v"), (u % 40).cast("string")).alias("source_url"))

    @cached_property
    def videos(self) -> DataFrame:
        """Videos seen in the posts, with play counts; two of them are missing on purpose."""
        v = F.col("v")
        return (
            self.raw("events").where("user_id % 20 <> 7")
            .groupBy((F.col("user_id") % 40).alias("v"))
            .agg(F.count(F.lit(1)).alias("plays"), F.min(F.to_date("ts")).alias("published_date"))
            .select(
                F.when(v % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("study_id"),
                F.concat(F.lit("v"), v.cast("string")).alias("video_id"),
                F.concat(F.lit("Video "), v.cast("string")).alias("title"),
                F.concat(F.lit("https://example.org/watch/"), v.cast("string")).alias("url"),
                _pick(vocab.CATEGORIES, F.floor(v / 2) % 5).alias("category"),
                F.when(v % 10 < 2, F.lit("official")).otherwise(F.lit("ugc")).alias("author_type"),
                "plays", "published_date"))

    @cached_property
    def annotations(self) -> DataFrame:
        """Labels of the posts; every 50th post is labelled a second time."""
        e = F.col("event_id")
        topic = _pick(vocab.TOPICS, e % 12)
        stance = F.when(e % 11 != 0, F.element_at(
            F.create_map(*[F.lit(x) for kv in (
                ("purchase", vocab.SUPPORT), ("error", vocab.OPPOSE), ("view", vocab.NEUTRAL),
                ("click", vocab.MIXED), ("signup", vocab.UNCLEAR)) for x in kv]), F.col("event_type")))
        relevant = F.when(e % 10 == 0, F.lit(None)).otherwise(e % 10 != 1)
        first = self.raw("events").select(
            F.when(F.col("user_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("study_id"),
            e.cast("string").alias("post_id"), (e * 2).alias("ann_seq"),
            relevant.alias("relevant"),
            F.when(e % 37 == 0, F.array(F.concat(F.lit("new:c"), (e % 3).cast("string"))))
            .when(e % 5 == 0, F.array(topic, _pick(vocab.TOPICS, (e + 1) % 12)))
            .otherwise(F.array(topic)).alias("topics"),
            stance.alias("stance"),
            F.when(e % 4 != 1, _pick(vocab.EMOTIONS, e % 8)).alias("emotion"),
            (e % 4).alias("intensity"),
            F.when(e % 13 == 0, F.lit("明显")).when(e % 17 == 0, F.lit("无法判断"))
            .when(e % 7 == 0, F.lit("可能")).otherwise(F.lit("无")).alias("irony"),
            _pick(vocab.INTENTS, e % 8).alias("intent"),
            F.when(F.col("event_type") == "error", _pick(vocab.ISSUE_TYPES, e % 8)).alias("issue_type"),
            ((e % 100) / 100).alias("confidence"),
            F.substring("props", 1, 10).alias("evidence_span"),
            F.when(e % 10 == 0, F.lit("unclear text")).alias("abstain_reason"),
            F.lit("cheap").alias("stage"))
        second = (first.where("cast(post_id as long) % 50 = 3")
                  .withColumn("ann_seq", F.col("ann_seq") + 1).withColumn("stance", F.lit(vocab.MIXED))
                  .withColumn("confidence", F.lit(0.9)).withColumn("stage", F.lit("strong")))
        return first.unionByName(second)

    @cached_property
    def dated_posts(self) -> DataFrame:
        return effective.with_offsets(self.posts, self.studies)

    @cached_property
    def relevant(self) -> DataFrame:
        return effective.relevant_posts(self.dated_posts, self.annotations)

    @cached_property
    def rollup(self) -> DataFrame:
        return metrics.topic_rollup(self.relevant, self.videos)

    @cached_property
    def conflict(self) -> DataFrame:
        return metrics.reply_conflict(self.relevant)

    @cached_property
    def topics(self) -> DataFrame:
        return metrics.topic_metrics(self.rollup, self.videos, self.conflict)

    @cached_property
    def stored(self) -> dict[str, DataFrame]:
        """Metric tables written once; rankings, claims and views read them."""
        return study.metric_tables(self.posts, self.annotations, self.videos, self.studies)

    @cached_property
    def text_posts(self) -> DataFrame:
        """Documents as comments of one study; some carry a promotion, an account or a symbol text."""
        d = F.col("doc_id")
        text = (F.when(d % 17 == 0, F.concat("text", F.lit(" 转发抽奖")))
                .when(d % 19 == 0, F.concat("text", F.lit(" 代充加微信 QQ:1234567")))
                .when(d % 23 == 0, F.lit("😀!"))
                .when(d % 29 == 0, F.concat(F.lit("@User9 UID: 12345678 "), F.col("text")))
                .when(d % 31 == 0, F.concat(F.lit("  ​收售 \t\t "), F.col("text"), F.lit("\n\n\n\n地图探索 ")))
                .otherwise(F.col("text")))
        return self.spread("documents").select(
            F.lit("D").alias("study_id"), d.alias("post_seq"), d.cast("string").alias("post_id"),
            F.col("source").alias("video_id"), F.lit(None).cast("string").alias("parent_id"), text.alias("text"),
            F.date_add(F.lit("2024-01-01").cast("date"), (d % 45).cast("int")).alias("published_date"),
            (F.col("n_chars") % 500).alias("likes"), F.lit(0).cast("long").alias("reply_count"),
            (d % 97).cast("string").alias("anon_user_id"), F.array().cast("array<string>").alias("flags"),
            F.concat(F.lit("https://example.org/"), "source").alias("source_url"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))


_E = "event_id"
_TOPICS = _sql_list(vocab.TOPICS)

SQL: dict[str, str] = {
    "studies": f"SELECT * FROM (VALUES {STUDY_ROWS}) t({STUDY_COLUMNS})",
    "posts": """
SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS study_id, event_id AS post_seq,
  CAST(event_id AS VARCHAR) AS post_id, 'v' || (user_id % 40) AS video_id,
  CASE WHEN event_id % 4 = 0 AND event_id >= 7 THEN CAST(event_id - 7 AS VARCHAR) END AS parent_id,
  event_type || ' ' || props AS text, ts AS published_at, CAST(ts AS DATE) AS published_date,
  CAST(floor(value) AS BIGINT) AS likes, event_id % 7 AS reply_count, CAST(user_id AS VARCHAR) AS anon_user_id,
  CASE WHEN event_id % 29 = 0 THEN ['lottery'] WHEN event_id % 31 = 0 THEN ['ad']
       WHEN event_id % 41 = 0 THEN ['duplicate'] ELSE CAST([] AS VARCHAR[]) END AS flags,
  'https://example.org/v' || (user_id % 40) AS source_url
FROM events""",
    "vids": f"""
SELECT CASE WHEN v % 2 = 0 THEN 'A' ELSE 'B' END AS study_id, 'v' || v AS video_id, 'Video ' || v AS title,
  'https://example.org/watch/' || v AS url, {_sql_list(vocab.CATEGORIES)}[(v // 2) % 5 + 1] AS category,
  CASE WHEN v % 10 < 2 THEN 'official' ELSE 'ugc' END AS author_type, plays, published_date
FROM (SELECT user_id % 40 AS v, count(*) AS plays, min(CAST(ts AS DATE)) AS published_date
      FROM events WHERE user_id % 20 <> 7 GROUP BY 1)""",
    "first_labels": f"""
SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS study_id, CAST(event_id AS VARCHAR) AS post_id,
  event_id * 2 AS ann_seq, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 10 <> 1 END AS relevant,
  CASE WHEN event_id % 37 = 0 THEN ['new:c' || (event_id % 3)]
       WHEN event_id % 5 = 0 THEN [{_TOPICS}[event_id % 12 + 1], {_TOPICS}[(event_id + 1) % 12 + 1]]
       ELSE [{_TOPICS}[event_id % 12 + 1]] END AS topics,
  CASE WHEN event_id % 11 <> 0 THEN CASE event_type WHEN 'purchase' THEN '支持' WHEN 'error' THEN '反对'
       WHEN 'view' THEN '中立' WHEN 'click' THEN '混合' WHEN 'signup' THEN '不明确' END END AS stance,
  CASE WHEN event_id % 4 <> 1 THEN {_sql_list(vocab.EMOTIONS)}[event_id % 8 + 1] END AS emotion,
  event_id % 4 AS intensity,
  CASE WHEN event_id % 13 = 0 THEN '明显' WHEN event_id % 17 = 0 THEN '无法判断'
       WHEN event_id % 7 = 0 THEN '可能' ELSE '无' END AS irony,
  {_sql_list(vocab.INTENTS)}[event_id % 8 + 1] AS intent,
  CASE WHEN event_type = 'error' THEN {_sql_list(vocab.ISSUE_TYPES)}[event_id % 8 + 1] END AS issue_type,
  (event_id % 100) / 100 AS confidence, substr(props, 1, 10) AS evidence_span,
  CASE WHEN event_id % 10 = 0 THEN 'unclear text' END AS abstain_reason, 'cheap' AS stage
FROM events""",
    "annotations": """
SELECT * FROM first_labels UNION ALL
SELECT * REPLACE (ann_seq + 1 AS ann_seq, '混合' AS stance, 0.9 AS confidence, 'strong' AS stage)
FROM first_labels WHERE CAST(post_id AS BIGINT) % 50 = 3""",
    "dated": """
SELECT p.*, s.t0_date, date_diff('day', t0_date, published_date) AS day_offset, preheat_lo, ferment_hi,
  CASE WHEN date_diff('day', t0_date, published_date) BETWEEN preheat_lo AND preheat_hi THEN 'preheat'
       WHEN date_diff('day', t0_date, published_date) BETWEEN launch_lo AND launch_hi THEN 'launch'
       WHEN date_diff('day', t0_date, published_date) BETWEEN ferment_lo AND ferment_hi THEN 'ferment' END AS phase,
  date_diff('day', t0_date, published_date) - preheat_lo AS day_index,
  date_diff('day', t0_date, published_date) BETWEEN preheat_lo AND ferment_hi AS in_window,
  ferment_hi - preheat_lo + 1 AS window_days
FROM posts p JOIN studies s USING (study_id)""",
    "effective": "SELECT * FROM dated WHERE NOT list_has_any(flags, ['duplicate', 'spam', 'lottery', 'ad'])",
    "labels_last": """
SELECT * FROM annotations QUALIFY row_number() OVER (PARTITION BY study_id, post_id ORDER BY ann_seq DESC) = 1""",
    "relevant": "SELECT * FROM effective JOIN labels_last USING (study_id, post_id) WHERE relevant",
    "topic_rows": """
SELECT r.*, u.topic, r.post_seq * 16 + u.pos AS topic_seq
FROM relevant r, LATERAL (SELECT unnest(r.topics) AS topic, generate_subscripts(r.topics, 1) - 1 AS pos) u""",
    "n_valid": "SELECT study_id, count(*) AS n_valid FROM relevant GROUP BY 1",
    "video_totals": "SELECT study_id, count(*) AS all_videos FROM vids GROUP BY 1",
    "edges": """
SELECT c.study_id, c.stance AS child_stance, p.stance AS parent_stance
FROM relevant c JOIN relevant p ON c.study_id = p.study_id AND c.parent_id = p.post_id
WHERE c.stance IN ('支持', '反对') AND p.stance IN ('支持', '反对')""",
    "conflict": """
SELECT study_id, count(*) AS edges, count(*) FILTER (child_stance <> parent_stance) AS opposed,
  count(*) FILTER (child_stance <> parent_stance) / count(*) AS reply_conflict FROM edges GROUP BY 1""",
    "topic_base": """
SELECT t.study_id, topic, min(topic_seq) AS topic_seq, count(*) AS count,
  count(*) FILTER (stance = '支持') AS support, count(*) FILTER (stance = '反对') AS oppose,
  count(*) FILTER (stance = '中立') AS neutral, count(*) FILTER (stance = '混合') AS mixed,
  count(*) FILTER (stance = '不明确') AS unclear, count(*) FILTER (stance IS NULL) AS abstain,
  avg(ln(1 + likes + reply_count)) AS engagement,
  coalesce(avg(intensity) FILTER (stance = '反对'), 0) AS oppose_mean,
  count(DISTINCT t.video_id) AS video_count, count(DISTINCT day_offset) FILTER (in_window) AS active_days,
  list_sort(coalesce(list(DISTINCT category) FILTER (category IS NOT NULL), CAST([] AS VARCHAR[])))
    AS video_categories,
  count(*) FILTER (in_window AND day_offset BETWEEN 0 AND 7) AS launch_n,
  count(*) FILTER (in_window AND day_offset >= 8) AS ferment_n, max(window_days) AS window_days
FROM topic_rows t LEFT JOIN vids v ON v.study_id = t.study_id AND v.video_id = t.video_id GROUP BY 1, 2""",
    "daily": """
SELECT b.study_id, b.topic, b.topic_seq, d.day_index, count(t.post_id) AS n
FROM topic_base b JOIN studies s USING (study_id), LATERAL (SELECT unnest(range(0, ferment_hi - preheat_lo + 1))
  AS day_index) d
LEFT JOIN topic_rows t ON t.study_id = b.study_id AND t.topic = b.topic AND t.day_index = d.day_index
GROUP BY ALL""",
    "trend": """
SELECT study_id, topic, CASE WHEN avg(n) > 0 THEN regr_slope(n, day_index) / avg(n) END AS trend_speed
FROM daily GROUP BY 1, 2""",
    "topics": """
SELECT b.*, all_videos, reply_conflict, count / n_valid AS topic_share,
  CASE WHEN support + oppose > 0 THEN (support - oppose) / (support + oppose) END AS net_support,
  CASE WHEN support + oppose > 0 THEN support / (support + oppose) END AS support_rate,
  entropy, volume, 0.5 * entropy + 0.3 * coalesce(reply_conflict, 0) + 0.2 * volume AS controversy,
  trend_speed, 0.5 * least(1, active_days / window_days) + 0.5 * least(1, video_count / all_videos) AS persistence,
  CASE WHEN stanced > 0 THEN oppose / stanced * oppose_mean / 3 ELSE 0 END AS oppose_intensity,
  (ferment_n - launch_n) / count AS growth_delta, least(1, video_count / all_videos) AS video_coverage,
  0.4 * len(video_categories) / 5 + 0.3 * least(1, video_count / all_videos)
    + 0.3 * greatest(0, least(1, (ferment_n - launch_n) / count)) AS ugc_diffusion,
  count * 1000.0 / n_valid AS per_1000, video_count * 10.0 / all_videos AS per_10_videos
FROM (SELECT x.*, n_valid, support + oppose + neutral + mixed AS stanced,
        CASE WHEN support + oppose + neutral + mixed = 0 THEN 0 ELSE
          -list_sum(list_transform(list_filter([support, oppose, neutral, mixed], lambda c: c > 0),
            lambda c: c / (support + oppose + neutral + mixed) * ln(c / (support + oppose + neutral + mixed))))
          / ln(4) END AS entropy,
        least(1, ln(1 + count) / ln(1 + greatest(n_valid, 1))) AS volume
      FROM topic_base x JOIN n_valid USING (study_id)) b
JOIN video_totals USING (study_id) LEFT JOIN conflict USING (study_id) JOIN trend USING (study_id, topic)""",
    "weights": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', '{c}', {i}, CAST({w} AS DOUBLE))"
        for k, ws in vocab.WEIGHTS.items() for i, (c, w) in enumerate(ws.items())
    ) + ") t(kind, component, ord, weight)",
    "components": """
SELECT study_id, topic, topic_seq, unnest(['issue', 'issue', 'issue', 'issue', 'issue', 'opportunity',
    'opportunity', 'opportunity', 'opportunity', 'opportunity']) AS kind,
  unnest(['oppose_intensity', 'topic_share', 'growth', 'engagement', 'persistence', 'support_rate', 'topic_growth',
    'video_coverage', 'engagement', 'persistence']) AS component,
  unnest([oppose_intensity, coalesce(topic_share, 0), greatest(0, least(1, growth_delta + 0.5)), engagement,
    persistence, coalesce(support_rate, 0), greatest(0, least(1, growth_delta + 0.5)), video_coverage, engagement,
    persistence]) AS raw FROM topics""",
    "norm": """
SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-12 THEN 0.5
  ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS value
FROM components WINDOW w AS (PARTITION BY study_id, kind, component)""",
    "scored": """
SELECT study_id, kind, topic, topic_seq, list_sum(list(value * weight ORDER BY ord)) AS score
FROM norm JOIN weights USING (kind, component) GROUP BY ALL""",
    "ranking": """
SELECT *, row_number() OVER (PARTITION BY study_id, kind ORDER BY score DESC, topic_seq) AS rank FROM scored""",
    "scenarios": """
SELECT kind, scenario, component, ord, w / sum(w) OVER (PARTITION BY kind, scenario) AS weight FROM (
  SELECT a.kind, b.component || CASE sign WHEN 1 THEN ' +' ELSE ' -' END || '10%' AS scenario, a.component, a.ord,
    CASE WHEN a.component = b.component THEN a.weight * (1 + sign * 0.1) ELSE a.weight END AS w
  FROM weights a JOIN weights b ON a.kind = b.kind, (VALUES (1), (-1)) s(sign))""",
    "shifts": """
SELECT r.*, k.rank AS base_rank, r.rank - k.rank AS rank_shift FROM (
  SELECT *, row_number() OVER (PARTITION BY study_id, kind, scenario ORDER BY score DESC, topic_seq) AS rank FROM (
    SELECT study_id, kind, scenario, topic, topic_seq, list_sum(list(value * weight ORDER BY ord)) AS score
    FROM norm JOIN scenarios USING (kind, component) GROUP BY ALL)) r
JOIN ranking k ON k.study_id = r.study_id AND k.kind = r.kind AND k.topic = r.topic""",
    "evidence": """
SELECT r.study_id, r.post_seq, r.post_id AS evidence_id, r.video_id, coalesce(v.title, r.video_id) AS video_title,
  coalesce(v.url, r.source_url) AS video_url, substr(r.text, 1, 80) AS text_excerpt, r.published_at, r.likes, r.topics,
  r.stance, r.emotion, r.irony, r.stage AS model_label_stage, r.confidence, r.source_url
FROM relevant r LEFT JOIN vids v ON v.study_id = r.study_id AND v.video_id = r.video_id""",
    "best": """
SELECT study_id, topic, coalesce(stance, '未标注') AS stance, post_id AS evidence_id, likes, post_seq,
  row_number() OVER (PARTITION BY study_id, topic, coalesce(stance, '未标注') ORDER BY likes DESC, post_id) AS rank
FROM topic_rows QUALIFY rank <= 3""",
    "text_posts": """
SELECT 'D' AS study_id, doc_id AS post_seq, CAST(doc_id AS VARCHAR) AS post_id, source AS video_id,
  CAST(NULL AS VARCHAR) AS parent_id,
  CASE WHEN doc_id % 17 = 0 THEN text || ' 转发抽奖'
       WHEN doc_id % 19 = 0 THEN text || ' 代充加微信 QQ:1234567'
       WHEN doc_id % 23 = 0 THEN '😀!'
       WHEN doc_id % 29 = 0 THEN '@User9 UID: 12345678 ' || text
       WHEN doc_id % 31 = 0 THEN '  ' || chr(8203) || '收售 ' || chr(9) || chr(9) || ' ' || text
            || repeat(chr(10), 4) || '地图探索 '
       ELSE text END AS text,
  CAST(DATE '2024-01-01' + CAST(doc_id % 45 AS INTEGER) AS DATE) AS published_date, n_chars % 500 AS likes,
  CAST(0 AS BIGINT) AS reply_count, CAST(doc_id % 97 AS VARCHAR) AS anon_user_id, CAST([] AS VARCHAR[]) AS flags,
  'https://example.org/' || source AS source_url
FROM documents""",
}


def oracle(select: str, extra: dict[str, str] | None = None) -> str:
    """A self-contained statement: the named table expressions select needs, then select itself."""
    known = {**SQL, **(extra or {})}
    needed: list[str] = []

    def visit(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", body)):
            if word in known and word not in needed and re.search(
                    rf"(?:\bFROM|\bJOIN|,)\s+{word}\b", body):
                visit(known[word])
                if word not in needed:
                    needed.append(word)

    visit(select)
    if not needed:
        return select
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({known[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{select}"
