"""Sample quotas, profiles, selection of videos and posts, and grouped splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from ..session import checkpointed, stage_table
from .effective import effective_posts, is_effective
from .order_stats import order_statistics


def quota_checks(dated: DataFrame, videos: DataFrame, studies: DataFrame, max_per_author: int = 10,
                 min_purity: float = 0.95) -> DataFrame:
    """One row per (study, check): value, lower and upper bound, passed."""
    eff = effective_posts(dated)
    posts = dated.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if("in_window").alias("inside"),
        F.count_if(is_effective(F.col("flags"))).alias("effective"))
    # Counts per video and per author are combined before the shuffle, so heavy keys stay small.
    per_video = eff.groupBy("study_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    per_author = eff.groupBy("study_id", "anon_user_id").agg(F.count(F.lit(1)).alias("n"))
    top_video = per_video.groupBy("study_id").agg(F.max("n").alias("top_video"))
    top_author = per_author.groupBy("study_id").agg(F.max("n").alias("top_author"))
    kinds = videos.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("videos"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in vocab.CATEGORIES])
    wide = studies.join(posts, "study_id")
    for part in (top_video, top_author, kinds):
        wide = wide.join(part, "study_id", "left")
    wide = wide.na.fill(0)
    none = F.lit(None)

    def check(name: str, value, lo, hi, passed):
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), lo.cast("double").alias("lo"),
                        hi.cast("double").alias("hi"), passed.alias("passed"))

    share = F.col("top_video") / F.nullif("effective", F.lit(0))
    purity = F.col("inside") / F.nullif("posts", F.lit(0))
    c = F.col
    checks = [
        check("videos", c("videos"), c("videos_lo"), c("videos_hi"),
              c("videos").between(c("videos_lo"), c("videos_hi"))),
        *[check(f"category_{k}", c(f"n_{k}"), c("min_per_category"), none, c(f"n_{k}") >= c("min_per_category"))
          for k in vocab.CATEGORIES],
        check("effective_posts", c("effective"), c("comments_lo"), c("comments_hi"),
              c("effective").between(c("comments_lo"), c("comments_hi"))),
        F.when(c("effective") > 0, check("video_share", share, none, c("max_share"), share <= c("max_share") + 1e-9)),
        F.when(c("posts") > 0, check("window_purity", purity, F.lit(min_purity), none, purity >= min_purity)),
        check("author_max", c("top_author"), none, F.lit(max_per_author), c("top_author") <= max_per_author),
    ]
    return wide.select("study_id", F.inline(F.array_compact(F.array(*checks))))


def profile(posts: DataFrame, videos: DataFrame) -> DataFrame:
    per_video = posts.groupBy("study_id", "video_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent_id").isNotNull()).alias("subs"))
    base = per_video.groupBy("study_id").agg(
        F.sum("n").alias("posts"), F.sum("subs").alias("sub_replies"),
        F.bround(F.max("n") / F.sum("n"), 4).alias("max_single_video_share"))
    kinds = videos.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("videos"),
        *[F.count_if(F.col("category") == c).alias(c) for c in vocab.CATEGORIES])
    return base.join(kinds, "study_id", "left")


def import_statistics(posts: DataFrame) -> DataFrame:
    """Text-length bins, time range and the largest author of an import."""
    size = F.length("text")
    per_author = posts.groupBy("study_id", "anon_user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(size < 10).alias("short"),
        F.count_if((size >= 10) & (size < 50)).alias("medium"), F.count_if(size >= 50).alias("long"),
        F.min("published_date").alias("first_day"), F.max("published_date").alias("last_day"))
    return per_author.groupBy("study_id").agg(
        *[F.sum(c).alias(c) for c in ("short", "medium", "long")], F.max("n").alias("max_per_author"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def grouped_split(groups: DataFrame, group: str, test_share: float = 0.3, seed: str = "42") -> DataFrame:
    """Assign each group of a study to test or train; rows of one group never part.

    The test groups are those with the smallest hash draws; their number is the rounded share
    of all groups, at least one.
    """
    keys = groups.select("study_id", group).distinct().withColumn(
        "draw", F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"))))
    limit = order_statistics(keys, "draw", {
        "limit": lambda n: F.greatest(F.bround(n * F.lit(test_share), 0).cast("long"), F.lit(1)) - 1})
    return keys.join(limit, "study_id").select(
        "study_id", group, F.when(F.col("draw") <= F.col("limit"), F.lit("test")).otherwise(F.lit("train"))
        .alias("part"))


def window_candidates(hits: DataFrame, t0: str, before: int = 10, after: int = 40) -> DataFrame:
    """Search hits published around t0, the first of each video within a category."""
    near = hits.where(F.col("pub_date").between(F.date_sub(F.lit(t0).cast("date"), before),
                                                F.date_add(F.lit(t0).cast("date"), after)))
    first = near.groupBy("category", "video_id").agg(F.min("seq").alias("seq"))
    return near.join(first, ["category", "video_id", "seq"], "left_semi")


def select_videos(candidates: DataFrame, per_category: int = 10, enough: int = 6) -> DataFrame:
    """Top videos per category by plays: official ones in official, others elsewhere; all when too few."""
    fits = F.col("is_official") == (F.col("category") == "official")
    pool = candidates.groupBy("category").agg(F.count_if(fits).alias("n_fit"))
    kept = candidates.join(pool, "category").where(fits | (F.col("n_fit") < enough))
    w = W.partitionBy("category").orderBy(F.col("play").desc(), "seq")
    top = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_category)
    reason = F.format_string("类别[%s] 检索词『%s』结果，播放 %d，发布 %s",
                             "category", "term", "play", F.date_format("pub_date", "yyyy-MM-dd"))
    return top.withColumn("relaxed", F.col("n_fit") < enough).withColumn("sampling_reason", reason).drop("n_fit")


def merge_selection(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Old selection wins by video; unfinished videos come first."""
    added = new.join(old.select("video_id"), "video_id", "left_anti").withColumn("_new", F.lit(1))
    both = old.withColumn("_new", F.lit(0)).unionByName(added)
    marks = done.select("video_id").distinct().withColumn("done", F.lit(True))
    return both.join(marks, "video_id", "left").withColumn("done", F.coalesce("done", F.lit(False))).withColumnRenamed(
        "_new", "added")


#: Posts of a study that are looked at first, as a multiple of the sample.
FRONT = 16


def stratified_sample(posts: DataFrame, n: int = 400, per_video: int = 10, relaxed_per_video: int = 12,
                      per_author: int = 3, seed: str = "42") -> DataFrame:
    """n posts per study in draw order under caps per video and author, then with the relaxed video cap.

    Equals one sequential pass over all posts in draw order, without making one: each round
    looks at the next few posts per study whose video and author still have room, so every round
    with a candidate adds a post and at most n rounds run (two or three in practice). The rounds run on the first
    FRONT * n posts of each study, stored once; all posts are looked at only for a study that those did not fill.
    """
    draw = F.md5(F.concat_ws("|", F.lit(seed), "study_id", "post_id"))
    pool = posts.select("study_id", "post_id", "video_id", "anon_user_id").withColumn("draw", draw)
    schema = "study_id string, post_id string, video_id string, anon_user_id string, draw string"
    spark = posts.sparkSession
    w = W.partitionBy("study_id").orderBy("draw")
    front = stage_table(pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= FRONT * n).drop("_rn"), "sample-front")
    sizes = checkpointed(pool.groupBy("study_id").agg(F.count(F.lit(1)).alias("all")))
    picked = spark.createDataFrame([], schema)
    for cap in (per_video, relaxed_per_video):
        for source in (front, pool):
            if source is pool:
                have = picked.groupBy("study_id").agg(F.count(F.lit(1)).alias("have"))
                short = sizes.join(have, "study_id", "left").where(
                    (F.col("all") > FRONT * n) & (F.coalesce("have", F.lit(0)) < n)).select("study_id")
                if short.isEmpty():
                    continue
                source = pool.join(short, "study_id", "left_semi")
            while True:
                rest = _with_room(source, picked, n, cap, per_author)
                chunk = rest.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 4 * n).drop("_rn")
                before = picked.count()
                grown = (chunk.groupBy("study_id").cogroup(picked.groupBy("study_id"))
                         .applyInPandas(_taker(n, cap, per_author), schema))
                picked = checkpointed(grown)
                if picked.count() in (before, 0):
                    break
    return picked


def _with_room(pool: DataFrame, picked: DataFrame, n: int, per_video: int, per_author: int) -> DataFrame:
    """Posts not picked whose study, video and author are below their caps; each list has at most n rows per study."""
    def full(keys: list[str], cap: int) -> DataFrame:
        return picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= cap).drop("c")

    out = pool
    for keys, cap in ((["study_id"], n), (["study_id", "video_id"], per_video), (["study_id", "anon_user_id"], per_author),
                      (["study_id", "post_id"], 1)):
        out = out.join(full(keys, cap), keys, "left_anti")
    return out


def _taker(n: int, per_video: int, per_author: int):
    def take(chunk, picked):
        import pandas as pd

        videos, authors = picked.video_id.value_counts().to_dict(), picked.anon_user_id.value_counts().to_dict()
        rows, size = [], len(picked)
        for r in chunk.sort_values("draw").itertuples(index=False):
            if size >= n:
                break
            if videos.get(r.video_id, 0) >= per_video or authors.get(r.anon_user_id, 0) >= per_author:
                continue
            rows.append(r)
            size += 1
            videos[r.video_id] = videos.get(r.video_id, 0) + 1
            authors[r.anon_user_id] = authors.get(r.anon_user_id, 0) + 1
        return pd.concat([picked, pd.DataFrame(rows, columns=chunk.columns)], ignore_index=True)

    return take


def fingerprint(tables: dict[str, DataFrame], buckets: int = 256) -> DataFrame:
    """Order-independent digest of tables: row digests are summed per bucket, then hashed per table."""
    out = None
    for name, df in sorted(tables.items()):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        part = df.select(row.alias("h")).select(
            (F.conv(F.substring("h", 1, 2), 16, 10).cast("long") % buckets).alias("bucket"),
            F.conv(F.substring("h", 3, 8), 16, 10).cast("decimal(20,0)").alias("x"),
            F.conv(F.substring("h", 11, 8), 16, 10).cast("decimal(20,0)").alias("y"))
        sums = part.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
        line = F.concat_ws(":", "bucket", "n", "x", "y")
        one = sums.agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(line)).alias("l")).select(
            F.lit(name).alias("table"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
            F.sha2(F.array_join("l", ";"), 256).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


class ChangedDataset(ValueError):
    """The tables differ from those that a fingerprint was taken of; tables: their names."""

    def __init__(self, tables: list[str]):
        super().__init__(f"changed since the fingerprint was taken: {', '.join(tables)}")
        self.tables = tables


def require_unchanged(tables: dict[str, DataFrame], stored: DataFrame) -> DataFrame:
    """The fingerprint of the tables; raises ChangedDataset if it is not the stored one (one row per table each)."""
    now = {r.table: (r.rows, r.digest) for r in fingerprint(tables).collect()}
    was = {r.table: (r.rows, r.digest) for r in stored.collect()}
    changed = sorted(t for t in now.keys() | was.keys() if now.get(t) != was.get(t))
    if changed:
        raise ChangedDataset(changed)
    return stored
