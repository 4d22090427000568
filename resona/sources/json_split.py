"""One large JSON document, an array of objects or an object with a data array, read by many tasks.

The text is read in Spark's own splits, cut at closing braces. Whether a brace counts depends on the parity of the quotes before it and
an element's borders on the depth; both are running sums. Every split sums its quotes and, for both states it may start in, its change of
depth, and one row per split decides its state and depth. Elements are then joined from their pieces and stored as JSON lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage_path, stage_table

SPLIT = ["file", "block"]
#: Whole strings, with what makes one the name of an array, and what changes the depth inside a piece.
_TOKENS = re.compile(r'"((?:[^"\\]++|\\.)*+)"(\s*+:\s*+\[)?|[\[\]{]', re.S)
_STRING_REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)


def _place() -> Column:
    return F.struct("block", "at")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _change(outside: Column, brace: Column) -> Column:
    """Change of depth by the text outside strings and, if it is outside too, by the brace behind it."""
    return _count(outside, "{[") - _count(outside, "]") - F.when(brace, 1).otherwise(0)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size, block, at, value, open, depth, closes, end): the text between closing braces.

    open: starts inside a string; depth, end: before it and behind its brace; closes: its brace is outside strings.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*+(?:"|\z)'
    shut, opened = F.regexp_replace("bare", strings, ""), F.regexp_replace(F.regexp_replace("bare", r'\A[^"]*+(?:"|\z)', ""), strings, "")
    counted = read.withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"')).select(
        *read.columns, "quotes", _change(shut, F.col("quotes") % 2 == 0).alias("shut"), _change(opened, F.col("quotes") % 2 == 1).alias("opened"))
    before = W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    even = F.col("odd") == 0
    # The change if the split starts outside a string, and if it starts inside one.
    counted = counted.withColumn("d0", F.when(even, F.col("shut")).otherwise(F.col("opened"))).withColumn(
        "d1", F.when(even, F.col("opened")).otherwise(F.col("shut")))
    counted = counted.withColumn("s0", F.coalesce(F.sum("d0").over(before), F.lit(0))).withColumn(
        "s1", F.coalesce(F.sum("d1").over(before), F.lit(0)))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = counted.groupBy(*SPLIT).agg((F.sum("quotes") % 2).alias("parity"), F.sum("d0").alias("t0"), F.sum("d1").alias("t1"))
    splits = splits.withColumn("inside", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("t0")).otherwise(F.col("t1"))).over(earlier), F.lit(0)))
    outside = F.col("inside") == 0
    placed = counted.join(splits.select(*SPLIT, "inside", "base"), SPLIT).withColumn("open", F.col("odd") != F.col("inside")).withColumn(
        "depth", F.col("base") + F.when(outside, F.col("s0")).otherwise(F.col("s1")))
    return placed.select(
        "file", "file_size", "block", "at", "value", "open", "depth",
        (F.col("open") == (F.col("quotes") % 2 == 1)).alias("closes"),
        (F.col("depth") + F.when(outside, F.col("d0")).otherwise(F.col("d1"))).alias("end"))


def data_start(value: str, depth: int, open_: bool) -> list[int]:
    """Where the arrays named data of the document's own object start in a piece: places behind their brackets."""
    at, found = 0, []
    if open_:
        rest = _STRING_REST.match(value)
        if rest is None:
            return []
        at = rest.end()
    for m in _TOKENS.finditer(value, at):
        mark = m[0][0]
        if mark == '"':
            if m[2]:
                if depth == 1 and m[1] == "data":
                    found.append(m.end())
                depth += 1
        else:
            depth += -1 if mark == "]" else 1
    return found


def _starts(placed: DataFrame) -> DataFrame:
    """(file, base, start, skip, unclear): where the array of elements begins, and the depth inside it; one row per file."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(f, k, a, s) for f, k, a, v, d, o in zip(*(b[c] for c in b.columns)) for s in data_start(v, d, o)]
            yield pd.DataFrame(found, columns=["file", "block", "at", "skip"])

    top = placed.where("depth <= 1")
    # Only pieces that may come down to the members of the document's own object can hold the name.
    reach = placed.where(F.contains("value", F.lit('"data"')) & (F.col("depth") - _count(F.col("value"), "]") <= 1))
    named = reach.select("file", "block", "at", "value", "depth", "open").mapInPandas(scan, "file string, block long, at long, skip int")
    named = named.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "at", "skip")).alias("named"))
    first = top.groupBy("file").agg(F.min(_place()).alias("first"), F.min_by("value", _place()).alias("head"))
    head = F.regexp_extract("head", r"\A\x{feff}?\s*(\[)?", 0)
    is_array = F.col("head").rlike(r"\A\x{feff}?\s*\[")
    return first.join(named, "file", "left").select(
        "file", is_array.alias("is_array"), F.when(is_array, 1).otherwise(2).alias("base"),
        F.when(is_array, F.col("first")).otherwise(F.struct(F.col("named.block").alias("block"), F.col("named.at").alias("at"))).alias("start"),
        F.when(is_array, F.length(head)).otherwise(F.col("named.skip")).alias("skip"),
        (~is_array & (F.coalesce("n", F.lit(0)) != 1)).alias("unclear"))


def elements(spark: SparkSession, path: str) -> DataFrame | None:
    """(text): the elements of the documents below path, each the text of an object without line breaks; None where the documents have
    another form (single objects, elements that are no objects, an array that does not end): those need the serial reader."""
    placed = stage_table(pieces(spark, path), "json-pieces")
    starts = _starts(placed)
    seen = starts.agg(F.count(F.lit(1)).alias("files"), F.count_if("unclear").alias("unclear")).first()
    if seen.files == 0 or seen.unclear:
        return None
    here = placed.join(F.broadcast(starts), "file").withColumn("place", _place())
    here = here.withColumn("begins", F.col("place") == F.col("start")).where("place >= start")
    border = (F.col("depth") == F.col("base")) & ~F.col("open") & ~F.col("begins")
    ends = here.where(border & F.col("value").rlike(r"\A\s*\]")).groupBy("file").agg(F.min("place").alias("stop"))
    tail = placed.groupBy("file", "file_size").agg(
        F.max_by(F.struct("value", "depth", "end", _place().alias("place")), _place()).alias("last"),
        F.sum(F.octet_length("value") + 1).alias("bytes"))
    # Each piece counts one byte for its brace, so the sum is one too many where the file does not end in a brace. Spark leaves out a byte order mark.
    braced = F.col("bytes").isin(F.col("file_size"), F.col("file_size") - 3)
    complete = F.when(F.col("is_array"), (F.col("last.place") == F.col("stop")) & F.col("last.value").rlike(r"\A\s*\]\s*\z")).otherwise(
        F.when(braced, F.col("last.end") == 0).otherwise(
            (F.col("last.depth") == 0) & F.col("last.value").rlike(r"\A\s*\z")))
    files = starts.join(ends, "file", "left").join(tail, "file")
    if not files.where(~F.coalesce(F.col("stop").isNotNull() & complete, F.lit(False))).isEmpty():
        return None
    body = here.join(F.broadcast(ends), "file").where("place < stop").withColumn(
        "value", F.when(F.col("begins"), F.expr("substring(value, skip + 1)")).otherwise(F.col("value")))
    body = body.withColumn("first", F.col("begins") | border)
    wanted = F.when(F.col("begins"), F.col("value").rlike(r"\A\s*\{")).otherwise(F.col("value").rlike(r"\A\s*,\s*\{"))
    if not body.where(F.col("first") & ~wanted).isEmpty():
        return None
    # An element is named by the place of its first piece, which may lie in an earlier split.
    latest = F.max(F.when(F.col("first"), F.col("at")))
    splits = body.groupBy(*SPLIT).agg(latest.alias("newest"))
    carried = splits.withColumn("carried", F.last(F.when(F.col("newest").isNotNull(), F.struct("block", F.col("newest").alias("at"))), True).over(
        W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select(*SPLIT, "carried")
    mine = latest.over(W.partitionBy(*SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    named = body.withColumn("mine", mine).join(carried, SPLIT).withColumn(
        "element", F.when(F.col("mine").isNotNull(), F.struct("block", F.col("mine").alias("at"))).otherwise(F.col("carried")))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))["value"]
    whole = named.groupBy("file", "element").agg(F.concat(F.array_join(parts, "}"), F.lit("}")).alias("text"))
    # Line breaks stand between tokens only; inside strings JSON has them escaped.
    return whole.select(F.regexp_replace(F.regexp_replace("text", r"\A[\s,]*", ""), r"[\r\n]", " ").alias("text"))


def as_lines(found: DataFrame) -> DataFrame:
    """The elements stored as JSON lines, which Spark splits freely, and parsed."""
    path = stage_path(found.sparkSession, "json-lines")
    found.write.text(path)
    return found.sparkSession.read.json(path)
