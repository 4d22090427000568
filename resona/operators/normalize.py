"""Window filter, cleaning, flags, spam removal and exact de-duplication of posts."""

from __future__ import annotations

from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..rules import DEFAULT, Rules
from ..session import stage_table
from .effective import with_offsets

#: Rows of a list of numbers up to which it is sent to all tasks instead of joined.
BROADCAST_IDS = 500_000


def staged(posts: DataFrame, studies: DataFrame, drop_spam: bool = True, only_window: bool = False, rules: Rules = DEFAULT) -> DataFrame:
    """Every input post with its cleaned text, flags and a stage: out_of_window, blank, spam or kept.

    kept says whether the row goes on; with drop_spam=False spam rows go on and are still counted.
    only_window drops the rows outside the study window before their texts are touched.
    """
    dated = with_offsets(posts, studies)
    if only_window:
        dated = dated.where("in_window")
    cleaned = X.once(X.once(dated, text=X.clean(F.col("text"))), flags=F.array_union(
        F.coalesce("flags", F.array().cast("array<string>")), X.detect_flags(F.col("text"), rules)))
    is_spam = F.array_contains("flags", "spam")
    stage = (F.when(~F.col("in_window"), F.lit("out_of_window"))
             .when(F.col("text") == "", F.lit("blank"))
             .when(is_spam, F.lit("spam")).otherwise(F.lit("kept")))
    going_on = F.lit("kept") if drop_spam else F.lit("spam")
    return cleaned.withColumn("stage", stage).withColumn(
        "kept", F.col("stage").isin("kept") | (F.col("stage") == going_on))


def first_of_copies(kept: DataFrame, stored: bool = False) -> DataFrame:
    """Add exact_hash and is_first: whether the post is the earliest with its text.

    The earliest post_seq per hash comes from a map-side combined minimum and is joined back on
    post_seq, which is unique, so a text copied into a third of all rows makes no hot key. With
    stored, the posts are written first, so that their texts are cleaned once for both sides, and moved only for very many heads.
    """
    hashed = X.once(kept, exact_hash=X.exact_hash(F.col("text")))
    if stored:
        hashed = stage_table(hashed, "hashed")
    heads = hashed.groupBy("study_id", "exact_hash").agg(F.min("post_seq").alias("post_seq")).select(
        "study_id", "post_seq", F.lit(True).alias("_first"))
    if stored:
        heads = stage_table(heads, "first-of-copies")
        heads = F.broadcast(heads) if heads.count() <= BROADCAST_IDS else heads
    return (hashed.join(heads, ["study_id", "post_seq"], "left")
            .withColumn("is_first", F.coalesce("_first", F.lit(False))).drop("_first"))


def mark_exact_duplicates(kept: DataFrame) -> DataFrame:
    """Later copies get the flag duplicate; all copies share the group of the first one."""
    marked = first_of_copies(kept)
    return marked.withColumn(
        "dedup_group", F.concat(F.lit("dg-"), F.substring("exact_hash", 1, 8))).withColumn(
        "flags", F.when(F.col("is_first"), F.col("flags")).otherwise(
            F.concat("flags", F.array(F.lit("duplicate")))))


def normalise(posts: DataFrame, studies: DataFrame, near: bool = True, drop_spam: bool = True) -> DataFrame:
    """The normalised posts: in window, cleaned, flagged, spam removed, duplicates marked."""
    return deduplicated(staged(posts, studies, drop_spam, only_window=True).where("kept"), near)


def deduplicated(kept: DataFrame, near: bool = True) -> DataFrame:
    """Duplicates marked among rows of staged that stay."""
    kept = kept.drop("kept", "stage")
    if near:
        from .near_duplicates import mark_duplicates

        return mark_duplicates(kept)
    return mark_exact_duplicates(kept)


def report(stages: DataFrame, normalised: DataFrame) -> DataFrame:
    """Counts per study; normalised posts include the flagged duplicates."""
    before = stages.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("total_in"),
        F.count_if(F.col("stage") == "out_of_window").alias("dropped_out_of_window"),
        F.count_if(F.col("stage").isin("blank", "spam")).alias("dropped_spam"))
    duplicate = F.array_contains("flags", "duplicate")
    after = normalised.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if(~duplicate).alias("duplicate_groups"),
        F.count_if(duplicate).alias("duplicates_flagged"),
        F.count_if(X.cjk_ratio(F.col("text")) < 0.15).alias("non_chinese"))
    return before.join(after, "study_id", "left").na.fill(0)


def keep_first_id(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row per key, the one with the lowest seq; only keys and seq are shuffled for the choice."""
    first = rows.groupBy(*key).agg(F.min(seq).alias(seq))
    return rows.join(first, [*key, seq], "left_semi")


def simhash(posts: DataFrame, key: list[str]) -> DataFrame:
    """64-bit similarity hash over character bigrams of the lower-cased text without blanks, row by row.

    Bit b is set if, over all bigrams, more of their hashes have it set than not; a text without a character has 0.
    """
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_simhash(t or "") for t in texts], dtype="int64")

    return posts.select(*key, F.pandas_udf(run, T.LongType())(X.drop_spaces(F.lower(F.col("text")))).alias("simhash"))


def _simhash(squeezed: str) -> int:
    if not squeezed:
        return 0
    grams = Counter(squeezed[i:i + 2] for i in range(max(1, len(squeezed) - 1)))
    raw = np.frombuffer(b"".join(md5(g.encode()).digest()[:8] for g in grams), np.uint8).reshape(-1, 8)
    weight = np.fromiter(grams.values(), np.int64, len(grams))
    set_ = weight @ np.unpackbits(raw, axis=1).astype(np.int64)
    return int(np.packbits(2 * set_ > weight.sum()).view(">i8")[0])


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))
