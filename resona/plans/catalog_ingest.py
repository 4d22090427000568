"""Queries over sources, sinks, column mapping, validation and landed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions import text as X
from ..functions.times import free_time
from ..operators import ingest
from ..schemas import GOLD, LABEL_FIELDS, POST
from ..session import stage_path
from ..sources import files, landed, sinks
from .bindings import Tables
from .registry import query


def _written(df: DataFrame, name: str, suffix: str) -> str:
    """Write rows derived from the tables as text lines below the shared folder."""
    path = stage_path(df.sparkSession, name) + suffix
    df.write.text(path)
    return path


def _raw_rows(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.raw("events").select(
        e.alias("rpid"), F.concat("event_type", F.lit(' "q",\n'), "props").alias("评论内容"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("评论时间"),
        F.concat(F.lit("https://example.org/"), e.cast("string")).alias("视频链接"),
        F.floor("value").cast("long").alias("点赞"))


_RAW_SQL = """
SELECT CAST(event_id AS VARCHAR) AS post_id, event_type || ' "q",' || chr(10) || props AS text,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at, 'https://example.org/' || event_id AS source_url,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS likes FROM events"""


def _csv(t: Tables) -> str:
    path = stage_path(t.spark, "import") + ".csv"
    _raw_rows(t).write.option("header", True).option("escape", '"').csv(path)
    return path


@query("src1_csv", _RAW_SQL)
def src1(t: Tables) -> DataFrame:
    df = files.read_csv(t.spark, _csv(t))
    return ingest.project(df, ingest.suggest_mapping(df.columns)).select(
        "post_id", "text", "published_at", "source_url", "likes")


def _json_lines(t: Tables) -> str:
    e = F.col("event_id")
    good = F.to_json(F.struct(e.alias("rpid"), F.col("event_type").alias("text"), "user_id"))
    odd = F.to_json(F.struct(F.lit("abc").alias("rpid"), F.col("event_type").alias("text"), "user_id"))
    line = (F.when(e % 50 == 1, F.lit('{"rpid": 1, "text"')).when(e % 50 == 2, F.lit("[1, 2]")).when(e % 50 == 3, odd)
            .otherwise(good))
    return _written(t.raw("events").select(line.alias("value")), "import", ".jsonl")


@query("src2_json_lines", """
SELECT 'row' AS kind, CASE WHEN event_id % 50 <> 3 THEN event_id END AS rpid, event_type AS text, user_id
FROM events WHERE event_id % 50 NOT IN (1, 2)
UNION ALL SELECT 'bad', count(*), NULL, NULL FROM events WHERE event_id % 50 IN (1, 2)
UNION ALL SELECT 'conflict', count(*), NULL, NULL FROM events WHERE event_id % 50 = 3""")
def src2(t: Tables) -> DataFrame:
    path = _json_lines(t)
    schema, none = "rpid long, text string, user_id long", F.lit(None)
    out = files.read_json_lines(t.spark, path, schema).select(F.lit("row").alias("kind"), "rpid", "text", "user_id")
    for kind, lines in (("bad", files.bad_lines(t.spark, path)), ("conflict", files.type_conflicts(t.spark, path, schema))):
        out = out.unionByName(lines.agg(F.count(F.lit(1)).alias("rpid")).select(
            F.lit(kind).alias("kind"), "rpid", none.cast("string").alias("text"), none.cast("long").alias("user_id")))
    return out


def _json_documents(t: Tables) -> str:
    """One {"data": [...]} document of at most 5,000 rows per file; smaller ones make thousands of files of a large table."""
    path = stage_path(t.spark, "import") + ".json"
    chunk = F.floor(F.col("event_id") / 5_000).alias("chunk")
    docs = t.raw("events").groupBy(chunk).agg(F.to_json(F.struct(F.collect_list(
        F.struct(F.col("event_id").alias("rpid"), F.col("event_type").alias("text"))).alias("data"))).alias("value"))
    docs.write.partitionBy("chunk").text(path)
    return path


@query("src3_json_document", "SELECT event_id AS rpid, event_type AS text FROM events")
def src3(t: Tables) -> DataFrame:
    return files.read_json_document(t.spark, _json_documents(t)).select("rpid", "text")


@query("src3_json_large_document", "SELECT event_id AS rpid, event_type AS text, event_id % 3 AS level FROM events")
def src3_large(t: Tables) -> DataFrame:
    """The table as documents of both forms, over one line or indented, read by split at their elements."""
    path = stage_path(t.spark, "large") + ".json"
    e = F.col("event_id")
    row = F.struct(e.alias("rpid"), F.col("event_type").alias("text"), F.struct((e % 3).alias("level")).alias("n"))
    rows = F.to_json(F.collect_list(row), {"pretty": "true"})
    docs = t.raw("events").groupBy(F.pmod(e, F.lit(8)).alias("part")).agg(rows.alias("value"))
    form = F.when(F.col("part") % 2 == 0, F.col("value")).otherwise(
        F.concat(F.lit('{"code": 0, "note": "}", "data": '), F.col("value"), F.lit(', "page": {"n": [1]}}')))
    docs.select("part", form.alias("value")).write.partitionBy("part").text(path)
    return files.read_json_document(t.spark, path, split=True).select("rpid", "text", "n.level")


@query("src4_format_dispatch", """
SELECT 'csv' AS format, count(*) AS n FROM events UNION ALL
SELECT 'json', count(*) FROM events UNION ALL
SELECT 'jsonl', count(*) FROM events WHERE event_id % 50 NOT IN (1, 2)""")
def src4(t: Tables) -> DataFrame:
    out = None
    for path in (_csv(t), _json_documents(t), _json_lines(t)):
        df = files.read_source(t.spark, path)
        key = "rpid"
        one = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(path.rsplit(".", 1)[1]).alias("format"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("src5_preview", "SELECT event_id AS rpid, event_type AS text FROM events ORDER BY event_id LIMIT 20")
def src5(t: Tables) -> DataFrame:
    df = files.read_json_document(t.spark, _json_documents(t))
    return files.preview(df.select("rpid", "text"), 20, "rpid")


def _study_folder(t: Tables) -> str:
    root = stage_path(t.spark, "study")
    # POST has two fields the adapter lacks; they are read back as null.
    t.posts.write.json(f"{root}/posts")
    t.videos.select("study_id", "video_id", "title", "url", "category", "author_type", F.struct(
        F.col("plays").alias("view")).alias("stats_snapshot")).write.json(f"{root}/videos")
    labels = t.annotations.where("stage = 'cheap' and cast(post_id as long) % 3 <> 0")
    entry = F.map_from_entries(F.array(F.struct("post_id", F.struct(*LABEL_FIELDS.fieldNames()))))
    labels.select(F.to_json(entry).alias("value")).write.text(f"{root}/labels")
    return root


@query("src6_load_study", """
SELECT p.post_id, p.likes, v.title, l.stance FROM posts p LEFT JOIN vids v USING (study_id, video_id)
JOIN labels_first l USING (post_id)""",
       labels_first="SELECT post_id, stance FROM first_labels WHERE CAST(post_id AS BIGINT) % 3 <> 0")
def src6(t: Tables) -> DataFrame:
    study = files.load_study(t.spark, _study_folder(t), gold_only=True)
    return study["posts"].join(study["videos"].select("video_id", "title"), "video_id", "left").join(
        study["labels"].select("post_id", "stance"), "post_id").select("post_id", "likes", "title", "stance")


def gold_rows(t: Tables) -> DataFrame:
    """Gold labels of every sixth post by one seed annotator, every 18th also by two people."""
    e = F.col("post_id").cast("long")
    base = t.annotations.where("stage = 'cheap'").where(e % 6 == 0).withColumn(
        "stance", F.when(e % 7 == 0, F.lit("反对")).otherwise(F.col("stance"))).withColumn(
        "relevant", F.when(e % 36 == 0, F.lit(None).cast("boolean")).otherwise(F.col("relevant")))
    seed = base.withColumn("annotator", F.lit("seed")).withColumn("annotator_type", F.lit("strong_model_seed"))
    human = base.where(e % 18 == 0).withColumn("annotator_type", F.lit("human"))
    ann = human.withColumn("annotator", F.lit("ann")).withColumn(
        "stance", F.when(e % 5 == 0, F.lit("支持")).otherwise(F.col("stance")))
    bob = human.where(e % 4 == 0).withColumn("annotator", F.lit("bob"))
    out = (seed.withColumn("gold_seq", e * 4).unionByName(ann.withColumn("gold_seq", e * 4 + 1))
           .unionByName(bob.withColumn("gold_seq", e * 4 + 2)))
    return out.drop("ann_seq", "stage")


GOLD_SQL = {
    "gold_base": """
SELECT * EXCLUDE (ann_seq, stage) REPLACE (CASE WHEN CAST(post_id AS BIGINT) % 7 = 0 THEN '反对' ELSE stance END AS stance,
  CASE WHEN CAST(post_id AS BIGINT) % 36 = 0 THEN NULL ELSE relevant END AS relevant)
FROM first_labels WHERE CAST(post_id AS BIGINT) % 6 = 0""",
    "gold": """
SELECT *, 'seed' AS annotator, 'strong_model_seed' AS annotator_type, CAST(post_id AS BIGINT) * 4 AS gold_seq FROM gold_base
UNION ALL
SELECT * REPLACE (CASE WHEN CAST(post_id AS BIGINT) % 5 = 0 THEN '支持' ELSE stance END AS stance),
  'ann', 'human', CAST(post_id AS BIGINT) * 4 + 1 FROM gold_base WHERE CAST(post_id AS BIGINT) % 18 = 0
UNION ALL
SELECT *, 'bob', 'human', CAST(post_id AS BIGINT) * 4 + 2 FROM gold_base
WHERE CAST(post_id AS BIGINT) % 36 = 0""",
    "gold_final": """
SELECT * FROM gold QUALIFY row_number() OVER (PARTITION BY study_id, post_id
  ORDER BY annotator_type = 'human' DESC, CASE WHEN annotator_type = 'human' THEN -gold_seq ELSE gold_seq END) = 1""",
}


@query("src7_gold_files", """
SELECT post_id, annotator, annotator_type, relevant, stance, array_to_string(topics, ',') AS topics FROM gold""",
       **GOLD_SQL)
def src7(t: Tables) -> DataFrame:
    path = stage_path(t.spark, "gold")
    columns = [f for f in GOLD.fieldNames() if f not in ("annotated_at", "note")]
    files.save_gold(gold_rows(t).select(*columns), path)
    return files.load_gold(t.spark, path).select(
        "post_id", "annotator", "annotator_type", "relevant", "stance", F.array_join("topics", ",").alias("topics"))


@query("src8_short_keys", """
SELECT post_id, relevant, stance, array_to_string(topics, ',') AS topics, intensity, round(confidence, 6) AS confidence,
  irony FROM (SELECT post_id, relevant, stance, CASE WHEN intensity = 3 THEN [] ELSE topics END AS topics,
  CASE WHEN intensity = 2 THEN 0 ELSE intensity END AS intensity,
  CASE WHEN intensity = 1 THEN 0.5 ELSE confidence END AS confidence, irony FROM first_labels)""")
def src8(t: Tables) -> DataFrame:
    from ..operators.labels import expand_short_keys

    i = F.col("intensity")
    batch = t.annotations.where("stage = 'cheap'").select(
        "post_id", F.col("relevant").alias("r"), F.col("stance").alias("s"),
        F.when(i != 3, F.col("topics")).alias("t"), F.when(i != 2, i).alias("i"),
        F.when(i != 1, F.col("confidence")).alias("c"), F.col("irony").alias("y"))
    return expand_short_keys(batch).select(
        "post_id", "relevant", "stance", F.array_join("topics", ",").alias("topics"), "intensity",
        F.round("confidence", 6).alias("confidence"), "irony")


def journal_path(t: Tables) -> str:
    e, u = F.col("event_id"), F.col("user_id")
    detail = F.struct(
        F.concat(F.lit("v"), (u % 40).cast("string")).alias("video_id"),
        F.when(e % 2 == 0, F.lit("3")).otherwise(F.lit("2")).alias("mode"),
        F.array(e.cast("string"), (e + 1).cast("string")).alias("post_ids"))
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.when(e % 9 == 0, F.lit("search")).otherwise(F.lit("comment")).alias("kind"),
        F.lit("u").alias("url"), (e % 13).alias("page"), (e % 20).alias("items"), detail.alias("detail")))
    cut = F.when(e % 97 == 0, F.substr(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    return _written(t.raw("events").select(cut.alias("value")), "journal", ".jsonl")


JOURNAL_SQL = {
    "journal": """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'search' ELSE 'comment' END AS kind, event_id % 13 AS page,
  event_id % 20 AS items, 'v' || (user_id % 40) AS video_id, CASE WHEN event_id % 2 = 0 THEN '3' ELSE '2' END AS mode
FROM events WHERE event_id % 97 <> 0""",
    "pages_seen": "SELECT DISTINCT video_id, mode, page FROM journal WHERE kind = 'comment'",
}


@query("src9_journal", "SELECT video_id, mode, page FROM pages_seen", **JOURNAL_SQL)
def src9(t: Tables) -> DataFrame:
    return landed.journal_pages(files.load_journal(t.spark, journal_path(t)))


@query("ag26_journal_totals", """
SELECT kind, count(*) AS entries, CAST(sum(items) AS BIGINT) AS items, count(DISTINCT (video_id, mode, page)) AS pages
FROM journal GROUP BY 1""", **JOURNAL_SQL)
def ag26(t: Tables) -> DataFrame:
    return landed.journal_totals(files.load_journal(t.spark, journal_path(t)))


@query("jn18_skip_collected", """
SELECT video_id, mode, page FROM (SELECT DISTINCT 'v' || (user_id % 40) AS video_id, '3' AS mode, event_id % 29 AS page
FROM events) WHERE (video_id, mode, page) NOT IN (SELECT video_id, mode, page FROM pages_seen)""", **JOURNAL_SQL)
def jn18(t: Tables) -> DataFrame:
    wanted = t.raw("events").select(
        F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("video_id"), F.lit("3").alias("mode"),
        (F.col("event_id") % 29).alias("page")).distinct()
    return landed.not_collected(wanted, files.load_journal(t.spark, journal_path(t)))


# ---------- sinks ----------

@query("snk1_stage_tables", "SELECT study_id, post_id, likes, 'r1' AS run_id FROM posts")
def snk1(t: Tables) -> DataFrame:
    root = stage_path(t.spark, "run")
    path = sinks.write_stage(t.posts.select("study_id", "post_id", "likes", F.lit("r1").alias("run_id")), root, "posts")
    if not sinks.stage_exists(t.spark, path):
        raise RuntimeError(f"stage table {path} was not committed")
    return t.spark.read.parquet(path).select("study_id", "post_id", "likes", "run_id")


@query("snk2_public_views", """
SELECT 'evidence' AS view_name, count(*) AS n FROM relevant UNION ALL SELECT 'topics', count(*) FROM topics""")
def snk2(t: Tables) -> DataFrame:
    from ..operators import evidence, privacy_scan

    items = evidence.evidence_items(t.relevant, t.videos).withColumn("text_excerpt", P.mask(F.col("text_excerpt")))
    tables = {"evidence": items, "topics": t.topics}
    for name, df in tables.items():
        privacy_scan.assert_clean(df, name)
    paths = sinks.write_views(tables, stage_path(t.spark, "views"))
    out = None
    for name, path in paths.items():
        one = t.spark.read.json(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("view_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("snk3_keyed_labels", "SELECT post_id, stance, stage FROM labels_last")
def snk3(t: Tables) -> DataFrame:
    from ..operators.labels import upsert

    cheap, strong = t.annotations.where("stage = 'cheap'"), t.annotations.where("stage = 'strong'")
    merged = upsert([cheap, strong], ["study_id", "post_id"], "ann_seq")
    path = sinks.write_keyed(merged, stage_path(t.spark, "labels"))
    return t.spark.read.parquet(path).select("post_id", "stance", "stage")


# ---------- mapping and validation ----------

def _import_rows(t: Tables) -> DataFrame:
    e = F.col("event_id")
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.raw("events").select(
        (e + 1).alias("row"), F.when(e % 13 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("text"),
        F.when(e % 17 == 0, F.lit("不是时间")).when(e % 5 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm"))
        .when(e % 7 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
        .otherwise(when).alias("published_at"),
        F.when(e % 19 != 0, F.lit("https://example.org")).alias("source_url"),
        F.when(e % 3 != 0, e.cast("string")).alias("post_id"), F.lit(None).cast("string").alias("video_id"),
        F.when(e % 4 == 0, F.lit("")).otherwise(F.lit("p")).alias("parent_id"),
        F.when(e % 23 == 0, F.lit("3.5")).when(e % 29 == 0, F.lit("")).otherwise((e % 50).cast("string")).alias("likes"),
        F.lit(None).cast("string").alias("reply_count"), F.lit(None).cast("string").alias("user_key"),
        F.lit(None).cast("string").alias("dedup_group"))


_IMPORT_SQL = {
    "imported": """
SELECT event_id + 1 AS row, event_id AS e, ts, event_type,
  concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'text' END, CASE WHEN event_id % 19 = 0 THEN 'source_url' END) AS missing,
  event_id % 17 = 0 AS bad_time, event_id % 23 = 0 AS bad_likes FROM events""",
    "import_errors": """
SELECT row, CASE WHEN missing <> '' THEN missing WHEN bad_time THEN 'published_at' ELSE '*' END AS field,
  CASE WHEN missing <> '' THEN 'missing required field' WHEN bad_time THEN 'unreadable time'
       ELSE 'not a whole number' END AS message, 'fatal' AS severity
FROM imported WHERE missing <> '' OR bad_time OR bad_likes""",
    "import_posts": """
SELECT row, CASE WHEN e % 3 <> 0 THEN CAST(e AS VARCHAR) ELSE 'imported-' || lpad(CAST(row AS VARCHAR), 6, '0') END AS post_id,
  'imported' AS video_id, CASE WHEN e % 4 <> 0 THEN 'p' END AS parent_id,
  strftime(CASE WHEN e % 5 = 0 THEN date_trunc('minute', ts) WHEN e % 7 = 0 THEN date_trunc('second', ts) - INTERVAL 8 HOUR
    ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS published_at,
  strftime(ts, '%Y-%m-%d') AS published_date, CASE WHEN e % 29 = 0 THEN 0 ELSE e % 50 END AS likes
FROM imported WHERE missing = '' AND NOT bad_time AND NOT bad_likes""",
}


@query("prj1_suggest_mapping", """
SELECT 'text' AS field, '评论内容' AS source, count(*) AS filled FROM events UNION ALL
SELECT 'published_at', '评论时间', count(*) FROM events UNION ALL SELECT 'source_url', '视频链接', count(*) FROM events
UNION ALL SELECT 'post_id', 'rpid', count(*) FROM events UNION ALL SELECT 'likes', '点赞', count(*) FROM events""")
def prj1(t: Tables) -> DataFrame:
    """Suggested mapping of an imported table and the number of filled rows per mapped field."""
    rows = _raw_rows(t)
    mapping = {f: s for f, s in ingest.suggest_mapping(rows.columns).items() if s}
    filled = rows.agg(*[F.count(F.col(f"`{s}`")).alias(f) for f, s in mapping.items()])
    return filled.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(s).alias("source"), F.col(f).alias("filled"))
        for f, s in mapping.items()])))


@query("prj2_required_fields", """
SELECT 'full' AS table_name, '' AS missing, count(*) AS n FROM events UNION ALL
SELECT 'partial', 'published_at,source_url', count(*) FROM events""")
def prj2(t: Tables) -> DataFrame:
    full = _raw_rows(t)
    out = None
    for name, df in (("full", full), ("partial", full.select("rpid", "评论内容"))):
        missing = ",".join(ingest.missing_required(ingest.suggest_mapping(df.columns)))
        one = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), F.lit(missing).alias("missing"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("prj3_project_rows", _RAW_SQL.replace("CAST(event_id AS VARCHAR)", "event_id").replace(
    "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)", "CAST(floor(value) AS BIGINT)"))
def prj3(t: Tables) -> DataFrame:
    rows = _raw_rows(t)
    return ingest.project(rows, ingest.suggest_mapping(rows.columns)).select(
        "post_id", "text", "published_at", "source_url", "likes")


@query("prj4_validation_errors", "SELECT * FROM import_errors", **_IMPORT_SQL)
def prj4(t: Tables) -> DataFrame:
    return ingest.rejected(ingest.validate(_import_rows(t)))


@query("prj5_import_verdict", """
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM import_errors) AS valid_count,
  (SELECT count(*) FROM import_errors) AS errors, false AS ok FROM imported""", **_IMPORT_SQL)
def prj5(t: Tables) -> DataFrame:
    return ingest.verdict(ingest.validate(_import_rows(t)))


@query("prj5_first_errors", "SELECT row, field, message FROM import_errors ORDER BY row LIMIT 50", **_IMPORT_SQL)
def prj5_first(t: Tables) -> DataFrame:
    return ingest.first_errors(ingest.validate(_import_rows(t))).select("row", "field", "message")


@query("prj6_import_defaults", "SELECT row, post_id, video_id, parent_id, likes FROM import_posts", **_IMPORT_SQL)
def prj6(t: Tables) -> DataFrame:
    return ingest.accepted(ingest.validate(_import_rows(t))).select("row", "post_id", "video_id", "parent_id", "likes")


@query("sc5_parse_time", "SELECT row, published_at, published_date FROM import_posts", **_IMPORT_SQL)
def sc5(t: Tables) -> DataFrame:
    return ingest.accepted(ingest.validate(_import_rows(t))).select(
        "row", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.date_format("published_date", "yyyy-MM-dd").alias("published_date"))


#: Forms a time is written in; two with an offset of eight hours and of minus five and a half.
_FREE_FORMS = [
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MMMM d, yyyy h:mm:ss a", "d MMM yyyy 'at' HH:mm:ss", "M/d/yyyy HH:mm:ss",
    "yyyyMMdd'T'HHmmss", "EEE MMM d HH:mm:ss yyyy", "HH:mm:ss d MMMM yyyy", "yyyy.M.d H:mm:ss '+0800'",
    "EEEE, MMMM d yyyy HH:mm:ss '-05:30'", "dd-MMM-yyyy HH:mm:ss"]


@query("sc5_free_times", """
SELECT event_id, CASE WHEN event_id % 11 < 10 THEN strftime(CAST(ts AS TIMESTAMP) - CASE event_id % 11 WHEN 7 THEN INTERVAL 480 MINUTE
  WHEN 8 THEN INTERVAL (-330) MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M:%S') END AS published_at,
  CASE WHEN event_id % 11 < 10 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') END AS published_date FROM events""")
def sc5_free(t: Tables) -> DataFrame:
    """Event times written in ten forms, and in one that is no time, read back."""
    ts, form = F.col("ts").cast("timestamp"), F.col("event_id") % 11
    text = F.concat(F.lit("some day in "), F.date_format(ts, "MMMM"))
    for i, pattern in enumerate(_FREE_FORMS):
        text = F.when(form == i, F.date_format(ts, pattern)).otherwise(text)
    rows = X.once(t.raw("events").select("event_id", text.alias("text")), _read=free_time(F.col("text")))
    return rows.select("event_id", F.date_format("_read.time", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
                       F.date_format("_read.day", "yyyy-MM-dd").alias("published_date"))


# ---------- landed payloads ----------

def _comment_pages(t: Tables) -> DataFrame:
    """Responses of up to 20 comments; some are refused at the top level or inside data."""
    e = F.col("event_id")
    reply = F.struct(
        e.alias("rpid"), F.when(e % 4 == 0, e - 7).otherwise(0).alias("parent"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ctime"), F.floor("value").alias("like"),
        (e % 7).alias("rcount"),
        F.struct(F.when(e % 11 == 0, F.lit(" \n")).otherwise(F.concat(F.lit(" "), "event_type")).alias("message"))
        .alias("content"), F.struct(F.col("user_id").cast("string").alias("mid")).alias("member"))
    page = F.floor(e / 20)
    rows = t.raw("events").groupBy(page.alias("page")).agg(F.collect_list(reply).alias("replies"))
    p = F.col("page")
    return rows.select(p, F.to_json(F.struct(
        F.when(p % 40 == 3, F.lit(-412)).otherwise(F.lit(0)).alias("code"),
        F.concat(F.lit("v"), (p % 40).cast("string")).alias("video_id"), F.lit("https://example.org").alias("source_url"),
        F.struct(F.when(p % 40 == 5, F.lit(-352)).otherwise(F.lit(0)).alias("code"), "replies").alias("data")))
        .alias("value"))


@query("prj8_landed_comments", """
SELECT CAST(event_id AS VARCHAR) AS post_id, 'v' || (event_id // 20 % 40) AS video_id,
  CASE WHEN event_id % 4 = 0 AND event_id <> 7 THEN CAST(event_id - 7 AS VARCHAR) END AS parent_id, event_type AS text,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS published_at, CAST(floor(value) AS BIGINT) AS likes,
  event_id % 7 AS reply_count, substr(sha256('fallback:' || user_id), 1, 16) AS anon_user_id
FROM events WHERE event_id % 11 <> 0 AND event_id // 20 % 40 <> 3""")
def prj8(t: Tables) -> DataFrame:
    pages = landed.parse(_comment_pages(t), landed.COMMENTS)
    return landed.comment_rows(pages, P.unsalted_pseudonym).select(
        "post_id", "video_id", "parent_id", "text", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        "likes", "reply_count", "anon_user_id")


@query("prj10_risk_codes", """
SELECT count(*) AS responses, count(*) FILTER (page % 40 IN (3, 5)) AS refused
FROM (SELECT DISTINCT event_id // 20 AS page FROM events)""")
def prj10(t: Tables) -> DataFrame:
    pages = landed.parse(_comment_pages(t), landed.COMMENTS)
    return pages.agg(F.count(F.lit(1)).alias("responses"),
                     F.count_if(landed.is_refused(F.col("r"))).alias("refused"))


def _search_pages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    hit = F.struct(
        k.alias("k"), F.when(k % 5 == 0, F.lit("article")).otherwise(F.lit("video")).alias("type"),
        F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("bvid"),
        F.concat(F.lit("<em>No</em> "), k.cast("string")).alias("title"), F.lit("up").alias("author"),
        F.col("o_custkey").cast("string").alias("mid"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        .alias("pubdate"), F.floor("o_totalprice").alias("play"), (k % 100).alias("review"))
    pages = t.raw("orders").groupBy(F.floor(k / 20).alias("page")).agg(
        F.array_sort(F.collect_list(hit)).alias("result"))
    return pages.select("page", F.to_json(F.struct(
        F.lit(0).alias("code"), F.lit("t").alias("term"), F.lit("guide").alias("category"),
        F.struct(F.lit(0).alias("code"), "result").alias("data"))).alias("value"))


@query("prj9_landed_videos", """
SELECT o_orderkey // 20 AS page, 'b' || o_custkey AS video_id, 'No ' || o_orderkey AS title,
  CAST(floor(o_totalprice) AS BIGINT) AS play, epoch(o_orderdate)::BIGINT AS pubdate,
  CAST(row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) AS INTEGER) AS rank
FROM orders WHERE o_orderkey % 5 <> 0""")
def prj9(t: Tables) -> DataFrame:
    pages = landed.parse(_search_pages(t), landed.SEARCH)
    return landed.search_rows(pages, "page").select("page", "video_id", "title", "play", "pubdate", "rank")


@query("prj9_landed_details", """
SELECT 'b' || o_orderkey AS video_id, 'No ' || o_orderkey AS title, CAST(o_custkey AS VARCHAR) AS owner_mid,
  CAST(floor(o_totalprice) AS BIGINT) AS plays, CAST(0 AS BIGINT) AS coins,
  strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderkey % 13 <> 0""")
def prj9_details(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = t.raw("orders").select(F.to_json(F.struct(
        F.when(k % 13 == 0, F.lit(-404)).otherwise(F.lit(0)).alias("code"),
        F.struct(F.concat(F.lit("b"), k.cast("string")).alias("bvid"), k.alias("aid"),
                 F.concat(F.lit("<b>No</b> "), k.cast("string")).alias("title"),
                 F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("pubdate"),
                 F.struct(F.col("o_custkey").cast("string").alias("mid")).alias("owner"),
                 F.struct(F.floor("o_totalprice").alias("view")).alias("stat")).alias("data"))).alias("value"))
    return landed.detail_rows(landed.parse(raw, landed.DETAIL)).select(
        "video_id", "title", "owner_mid", F.col("stats_snapshot.view").alias("plays"),
        F.col("stats_snapshot.coin").alias("coins"), F.date_format("published_at", "yyyy-MM-dd").alias("published"))


@query("flt13_error_marker", "SELECT event_id FROM events WHERE event_type <> 'error'")
def flt13(t: Tables) -> DataFrame:
    rows = t.raw("events").withColumn("_err", F.when(F.col("event_type") == "error", F.col("props")))
    return landed.without_marker(rows).select("event_id")


@query("w13_cap_per_video", """
SELECT post_id, video_id FROM posts QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY post_seq) <= 110""")
def w13(t: Tables) -> DataFrame:
    return landed.capped_per_video(t.posts, 110).select("post_id", "video_id")
