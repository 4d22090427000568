"""Queries that run the streaming jobs over the tables to completion, and the pair similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import near_duplicates, normalize
from ..session import stage_path
from ..streaming import jobs
from .bindings import Tables
from .catalog_ingest import _IMPORT_SQL, _import_rows
from .catalog_labels import _REVIEW_SQL, reviews
from .registry import query


def _landed(df: DataFrame, name: str, triggers: int = 4) -> tuple[str, DataFrame]:
    """Rows as a folder of files and a stream over it in so many triggers."""
    path = stage_path(df.sparkSession, name)
    # As many files a trigger as tasks can write and read at once.
    each = max(1, df.sparkSession.sparkContext.defaultParallelism // triggers)
    df.repartition(triggers * each).write.parquet(path)
    return path, jobs.read_folder(df.sparkSession, path, df.schema, max_files=each)


@query("st1_stream_import", """
SELECT 'rejected' AS part, count(*) AS n, CAST(sum(row) AS BIGINT) AS row_sum FROM import_errors UNION ALL
SELECT 'accepted', count(*), CAST(sum(row) AS BIGINT) FROM import_posts""", **_IMPORT_SQL)
def st1(t: Tables) -> DataFrame:
    _, stream = _landed(_import_rows(t), "incoming")
    out = stage_path(t.spark, "imported")
    jobs.import_posts(stream, out, stage_path(t.spark, "cp")).awaitTermination()
    parts = [t.spark.read.parquet(f"{out}/{p}").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("row_sum")).select(
        F.lit(p).alias("part"), "n", "row_sum") for p in ("accepted", "rejected")]
    return parts[0].unionByName(parts[1])


@query("st2_stream_first_seen", "SELECT study_id, post_id FROM posts")
def st2(t: Tables) -> DataFrame:
    """Every post arrives twice; the second arrival is dropped."""
    rows = t.posts.select("study_id", "post_id", "published_at", "likes")
    _, stream = _landed(rows.unionByName(rows), "collected")
    out = stage_path(t.spark, "unique")
    jobs.first_seen(stream, out, stage_path(t.spark, "cp")).awaitTermination()
    return t.spark.read.parquet(out).select("study_id", "post_id")


@query("st3_stream_daily_counts", """
SELECT study_id, topic, strftime(published_date, '%Y-%m-%d') AS day, count(*) AS n
FROM (SELECT p.study_id, p.published_date, unnest(l.topics) AS topic
      FROM posts p JOIN first_labels l ON l.study_id = p.study_id AND l.post_id = p.post_id) GROUP BY 1, 2, 3""")
def st3(t: Tables) -> DataFrame:
    labels = t.annotations.where("stage = 'cheap'").select("study_id", "post_id", "topics")
    rows = t.posts.select("study_id", "post_id", "published_at").join(labels, ["study_id", "post_id"])
    _, stream = _landed(rows.select("study_id", "published_at", "topics"), "labelled")
    out = stage_path(t.spark, "daily")
    jobs.daily_counts(stream, out, stage_path(t.spark, "cp")).awaitTermination()
    return jobs.daily_totals(t.spark, out).select(
        "study_id", "topic", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("st4_stream_reviews", "SELECT study_id, post_id, field, after FROM latest", **_REVIEW_SQL)
def st4(t: Tables) -> DataFrame:
    _, stream = _landed(reviews(t), "reviews")
    out = stage_path(t.spark, "latest")
    jobs.latest_reviews(stream, out, stage_path(t.spark, "cp")).awaitTermination()
    return jobs.current_reviews(t.spark, out).select("study_id", "post_id", "field", "after")


def _distinct_texts(t: Tables) -> DataFrame:
    return near_duplicates.distinct_texts(normalize.staged(t.text_posts, t.studies).where("kept"))


@query("jn15_near_duplicate_join")
def jn15(t: Tables) -> DataFrame:
    """Every similar pair of distinct texts."""
    return near_duplicates.similar_pairs(_distinct_texts(t))


@query("udf3_pair_similarity")
def udf3(t: Tables) -> DataFrame:
    """The pair check on every candidate pair (checked against the plain measure in the tests)."""
    return near_duplicates.checked_pairs(_distinct_texts(t)).select("p", "w", "near")
