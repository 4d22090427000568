"""CSV whose quoted fields hold line breaks, read by many tasks.

Whether a line starts a record depends on all quotes before it, but only on their parity. Lines are read in Spark's own splits;
every group of lines in a split counts its quotes and, for both states it may start in, its record starts. One row per group decides the states and the
numbers of the records before it; lines with one record number are one record.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a split are counted in groups of 2 ** CHUNK_BITS, so that no window holds a whole split.
SPLIT, CHUNK_BITS = ["file", "block", "chunk"], 14
# A record in which every quote opens, closes or is doubled inside a quoted field; no backtracking.
_FIELD = r'(?:"(?:[^"]|"")*+"|[^",\r\n]*+)'
STRICT = rf"^{_FIELD}(?:,{_FIELD})*+$"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of UTF-8 files, numbered from 1 in each file, blank ones left out of the rows but not of the numbers.

    A window holds a bounded number of lines. As in the serial reader, a line break inside a field stays as it is
    written, but is a single character in a file whose first line ends in two. One at the end of a record goes. A quote that never closes makes one record of all that follows it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at")).withColumn("chunk", F.shiftright("at", CHUNK_BITS))
    before = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    # Whether the number of quotes before the line, within its group, is odd.
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    splits = lines.groupBy(*SPLIT).agg(
        (F.sum("quotes") % 2).alias("parity"), F.count_if(F.col("odd") == 0).alias("closed"), F.count_if(F.col("odd") == 1).alias("opened"),
        F.min_by(F.col("value").endswith("\r"), "at").alias("crlf"))
    earlier = W.partitionBy("file").orderBy("block", "chunk").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("open") == 0, F.col("closed")).otherwise(F.col("opened"))
    splits = splits.withColumn("first", F.coalesce(F.sum(starts).over(earlier), F.lit(0))).withColumn(
        "crlf", F.first("crlf").over(W.partitionBy("file").orderBy("block", "chunk"))).select(*SPLIT, "open", "first", "crlf")
    upto = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.join(splits, SPLIT).withColumn(
        "record", F.col("first") + F.sum(F.when(F.col("odd") == F.col("open"), 1).otherwise(0)).over(upto))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))["value"]
    whole = placed.groupBy("file", "record").agg(
        F.regexp_replace(F.array_join(parts, "\n"), r"\r$", "").alias("text"), F.max("crlf").alias("crlf"))
    whole = whole.withColumn("text", F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))).drop("crlf")
    return whole.withColumn("text", F.when(F.col("record") == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))).where("text <> ''")


def header(found: DataFrame) -> list[str]:
    """The names in the first record of the first file."""
    first = found.where("record = 1").orderBy("file").select("text").first()
    return next(csv.reader([first.text])) if first else []


def is_strict(found: DataFrame) -> bool:
    """Whether all quotes are where the format wants them; else parity doesn't say where records start."""
    return found.where(~F.col("text").rlike(STRICT)).isEmpty()


def rows(found: DataFrame, names: list[str]) -> DataFrame:
    """The records after each file's first as columns of text."""
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    return found.where("record > 1").select(F.from_csv("text", schema, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
