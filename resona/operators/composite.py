"""Composite scores, ranks and the weight sensitivity of a ranking (topic-sized tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions import measures as M


def components(topics: DataFrame) -> DataFrame:
    """Long table (study, topic, topic_seq, kind, component, raw) of both composites."""
    growth = M.clip01(F.col("growth_delta") + 0.5)
    values = {
        ("issue", "oppose_intensity"): F.col("oppose_intensity"),
        ("issue", "topic_share"): F.coalesce(F.col("topic_share"), F.lit(0.0)),
        ("issue", "growth"): growth,
        ("issue", "engagement"): F.col("engagement"),
        ("issue", "persistence"): F.col("persistence"),
        ("opportunity", "support_rate"): F.coalesce(F.col("support_rate"), F.lit(0.0)),
        ("opportunity", "topic_growth"): growth,
        ("opportunity", "video_coverage"): F.col("video_coverage"),
        ("opportunity", "engagement"): F.col("engagement"),
        ("opportunity", "persistence"): F.col("persistence"),
    }
    rows = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(c).alias("component"), v.cast("double").alias("raw"))
        for (k, c), v in values.items()])
    return topics.select("study_id", "topic", "topic_seq", F.inline(rows))


def normalised(comps: DataFrame) -> DataFrame:
    """Min-max over the topics of a study; 0.5 when all topics are equal."""
    w = W.partitionBy("study_id", "kind", "component")
    return comps.withColumn("value", M.minmax(F.col("raw"), F.min("raw").over(w), F.max("raw").over(w)))


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    weights = weights or vocab.WEIGHTS
    rows = [(k, c, i, w) for k, ws in weights.items() for i, (c, w) in enumerate(ws.items())]
    values = ", ".join(f"('{k}', '{c}', {i}, {w!r}D)" for k, c, i, w in rows)
    return spark.sql(f"select * from values {values} as t(kind, component, ord, weight)")


def scenario_table(spark: SparkSession, weights: dict[str, dict[str, float]] | None = None,
                   perturb: float = 0.10) -> DataFrame:
    """Every weight raised and lowered by perturb and renormalised: two scenarios per weight."""
    base = weight_table(spark, weights)
    changed = base.select("kind", F.col("component").alias("changed"), F.explode(F.array(F.lit(1), F.lit(-1)))
                          .alias("sign"))
    moved = base.join(changed, "kind").withColumn(
        "weight",
        F.when(F.col("component") == F.col("changed"), F.col("weight") * (1 + F.col("sign") * perturb))
        .otherwise(F.col("weight")))
    total = F.sum("weight").over(W.partitionBy("kind", "changed", "sign"))
    label = F.concat(F.col("changed"), F.when(F.col("sign") > 0, F.lit(" +")).otherwise(F.lit(" -")),
                     F.lit(f"{int(perturb * 100)}%"))
    return moved.select("kind", label.alias("scenario"), "component", "ord", (F.col("weight") / total).alias("weight"))


def scores(norm: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum per topic; terms are added in weight order so equal inputs give equal sums."""
    extra = [c for c in ("scenario",) if c in weights.columns]
    terms = norm.join(F.broadcast(weights), ["kind", "component"])
    ordered = F.array_sort(F.collect_list(F.struct("ord", (F.col("value") * F.col("weight")).alias("term"))))
    return (
        terms.groupBy("study_id", "kind", *extra, "topic", "topic_seq").agg(ordered.alias("t"))
        .withColumn("score", F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["term"]))
        .drop("t"))


def ranked(scored: DataFrame) -> DataFrame:
    """Rank by score, ties in order of first mention."""
    extra = [c for c in ("scenario",) if c in scored.columns]
    w = W.partitionBy("study_id", "kind", *extra).orderBy(F.col("score").desc(), F.col("topic_seq"))
    return scored.withColumn("rank", F.row_number().over(w))


def sensitivity(norm: DataFrame, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    spark = norm.sparkSession
    base = ranked(scores(norm, weight_table(spark, weights))).select(
        "study_id", "kind", "topic", F.col("rank").alias("base_rank"))
    moved = ranked(scores(norm, scenario_table(spark, weights)))
    return (moved.join(base, ["study_id", "kind", "topic"])
            .withColumn("rank_shift", F.col("rank") - F.col("base_rank")))


def max_rank_shift(shifts: DataFrame) -> DataFrame:
    return shifts.groupBy("study_id", "kind").agg(F.max(F.abs("rank_shift")).alias("max_rank_shift"))
