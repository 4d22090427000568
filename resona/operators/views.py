"""Read views over the stored metric tables (topic-sized) and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage_table

STANCE_PARTS = ["support", "oppose", "neutral", "mixed", "unclear", "abstain"]


def _rank(*order) -> "F.Column":
    return F.row_number().over(W.partitionBy("study_id").orderBy(*order))


def overview(topics: DataFrame, ranking: DataFrame, top: int = 5) -> DataFrame:
    listed = topics.select(
        "study_id", F.lit("topic").alias("section"), "topic", F.col("count").cast("double").alias("value"),
        _rank(F.col("count").desc(), "topic_seq").alias("rank"))
    best = ranking.where(F.col("rank") <= top).select(
        "study_id", F.col("kind").alias("section"), "topic", F.col("score").alias("value"), "rank")
    return listed.unionByName(best)


def top_volume(daily: DataFrame, topics: DataFrame, top: int = 8) -> DataFrame:
    totals = daily.groupBy("study_id", "topic", "topic_seq").agg(F.sum("n").alias("total"))
    both = totals.join(topics.select("study_id", "topic", "trend_speed"), ["study_id", "topic"])
    return both.select(
        "study_id", "topic", "total", _rank(F.col("total").desc(), "topic_seq").alias("volume_rank"),
        _rank(F.coalesce("trend_speed", F.lit(-99.0)).desc(), "topic_seq").alias("trend_rank"),
    ).where(F.col("volume_rank") <= top)


def controversy(topics: DataFrame, best: DataFrame, top: int = 8) -> DataFrame:
    ranked = topics.withColumn("_r", _rank(F.col("controversy").desc(), "topic_seq")).where(F.col("_r") <= top)
    per_stance = best.groupBy("study_id", "topic", "stance").agg(
        F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))).alias("e"))
    return ranked.select("study_id", "topic", "controversy", "reply_conflict", "net_support").join(
        per_stance, ["study_id", "topic"]).withColumn("evidence", F.col("e.evidence_id")).drop("e")


def by_sign(topics: DataFrame, side: str) -> DataFrame:
    value = F.coalesce("net_support", F.lit(0.0))
    return topics.where(value < 0 if side == "negative" else value > 0).withColumn("side", F.lit(side))


def stance_parts(topics: DataFrame) -> DataFrame:
    return topics.unpivot(["study_id", "topic"], STANCE_PARTS, "part", "value").where("value > 0")


class Pages:
    """Rows in one order, stored once so that a page reads the files that hold it.

    The rows are sorted by range, so no task sees all of them; a row's place is its file and the row number there, columns with least and
    greatest values per file. The number of rows per file, one number per task of the write, says where an offset lies. The order
    must tell all rows apart, else equal rows keep the places of the first write. Null keys come first, as in a sort.
    """

    def __init__(self, rows: DataFrame, order: list[str], name: str = "pages"):
        part = F.spark_partition_id()
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*", part.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("_at"))
        self.columns = rows.columns
        self.table = stage_table(placed, name)
        self.sizes = [(r._part, r.n) for r in self.table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()]

    def __len__(self) -> int:
        return sum(n for _, n in self.sizes)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset + 1 to offset + limit, in order; none beyond the end."""
        wanted, start = F.lit(False), 0
        for part, n in self.sizes:
            lo, hi = max(offset - start, 0), min(offset + limit - start, n) - 1
            if lo <= hi:
                wanted = wanted | ((F.col("_part") == part) & F.col("_at").between(lo, hi))
            start += n
        return self.table.where(wanted).orderBy("_part", "_at").select(*self.columns)
