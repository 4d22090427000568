"""Landed API responses (comments, search hits, video details) as canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X

COMMENTS = """code long, video_id string, source_url string, data struct<code:long, replies:array<struct<
rpid:long, parent:long, ctime:long, `like`:long, rcount:long,
content:struct<message:string>, member:struct<mid:string>>>>"""
SEARCH = """code long, term string, category string, data struct<code:long, result:array<struct<
type:string, bvid:string, title:string, author:string, mid:string, pubdate:long, play:long, review:long>>>"""
DETAIL = """code long, data struct<code:long, bvid:string, aid:long, title:string, pubdate:long,
owner:struct<mid:string, name:string>,
stat:struct<view:long, `like`:long, coin:long, favorite:long, share:long, reply:long>>"""


def parse(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    return raw.withColumn("r", F.from_json(column, schema))


def is_refused(response: Column) -> Column:
    """Whether a response carries a risk code at the top or inside data."""
    codes = [F.lit(c) for c in vocab.RISK_CODES]
    return (F.coalesce(response["code"].isin(*codes), F.lit(False))
            | F.coalesce(response["data"]["code"].isin(*codes), F.lit(False)))


def comment_rows(responses: DataFrame, anon) -> DataFrame:
    """Posts of landed comment pages: blank messages skipped, parent 0 means a top comment."""
    c = responses.where(F.col("r.code") == 0).select(
        F.col("r.video_id").alias("video_id"), F.col("r.source_url").alias("source_url"),
        F.explode("r.data.replies").alias("c"))
    message = X.strip(F.coalesce(F.col("c.content.message"), F.lit("")))
    return c.withColumn("text", message).where("text <> ''").select(
        F.col("c.rpid").cast("string").alias("post_id"), "video_id",
        F.when(F.col("c.parent") != 0, F.col("c.parent").cast("string")).alias("parent_id"), "text",
        F.timestamp_seconds(F.coalesce("c.ctime", F.lit(0))).alias("published_at"),
        F.coalesce("c.like", F.lit(0).cast("long")).alias("likes"),
        F.coalesce("c.rcount", F.lit(0).cast("long")).alias("reply_count"),
        anon(F.coalesce("c.member.mid", F.lit(""))).alias("anon_user_id"), "source_url")


def search_rows(responses: DataFrame, key: str) -> DataFrame:
    """Video hits of landed search pages; rank counts the video hits of a page in order."""
    hits = responses.where(F.col("r.code") == 0).select(
        key, F.col("r.term").alias("term"), F.col("r.category").alias("category"),
        F.filter("r.data.result", lambda x: x["type"] == "video").alias("hits"))
    return hits.select(key, "term", "category", F.posexplode("hits").alias("pos", "h")).select(
        key, "term", "category", (F.col("pos") + 1).alias("rank"),
        F.coalesce("h.bvid", F.lit("")).alias("video_id"), X.strip_tags(F.col("h.title")).alias("title"),
        "h.author", "h.mid", "h.pubdate",
        F.coalesce("h.play", F.lit(0).cast("long")).alias("play"),
        F.coalesce("h.review", F.lit(0).cast("long")).alias("review"))


def detail_rows(responses: DataFrame) -> DataFrame:
    d = responses.where(F.col("r.code") == 0).select("r.data.*")
    return d.select(
        F.col("bvid").alias("video_id"), "aid", X.strip_tags(F.col("title")).alias("title"),
        F.timestamp_seconds("pubdate").alias("published_at"),
        F.col("owner.mid").alias("owner_mid"), F.col("owner.name").alias("owner_name"),
        F.struct(*[F.coalesce(F.col(f"stat.{s}"), F.lit(0).cast("long")).alias(n) for n, s in (
            ("view", "view"), ("like", "like"), ("coin", "coin"), ("favorite", "favorite"), ("share", "share"),
            ("comment", "reply"))]).alias("stats_snapshot"))


def capped_per_video(posts: DataFrame, cap: int) -> DataFrame:
    """At most cap posts per video in read order (top-k per group, pruned before the shuffle)."""
    w = W.partitionBy("video_id").orderBy("post_seq")
    return posts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def without_marker(rows: DataFrame, marker: str = "_err") -> DataFrame:
    return rows.where(F.col(marker).isNull())


def journal_pages(journal: DataFrame) -> DataFrame:
    """Distinct (video, mode, page) of the comment pages a journal has recorded."""
    pages = journal.where("kind = 'comment' and coalesce(detail.video_id, '') <> ''")
    return pages.select("detail.video_id", F.coalesce("detail.mode", F.lit("")).alias("mode"),
                        F.coalesce("page", F.lit(0).cast("long")).alias("page")).distinct()


def journal_posts(journal: DataFrame) -> DataFrame:
    pages = journal.where("kind = 'comment' and coalesce(detail.video_id, '') <> ''")
    return pages.select(F.explode("detail.post_ids").alias("post_id")).distinct()


def not_collected(pages: DataFrame, journal: DataFrame) -> DataFrame:
    return pages.join(journal_pages(journal), ["video_id", "mode", "page"], "left_anti")


def journal_totals(journal: DataFrame) -> DataFrame:
    return journal.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce("items", F.lit(0))).alias("items"),
        F.count_distinct("detail.video_id", "detail.mode", "page").alias("pages"))
