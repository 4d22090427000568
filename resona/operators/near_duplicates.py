"""Greedy near-duplicate groups, exactly as a sequential pass over the posts would form them.

The sequential rule: a post joins the first group head it resembles (heads of the length
bucket below, the same bucket, the bucket above; older heads first), otherwise it becomes a
head. Heads are therefore the posts that resemble no earlier head.

Only posts whose length buckets touch and that share one of their rare bigrams can
resemble each other (a prefix filter without false negatives), so posts are indexed by
(study, bucket, bigram). Heads are found in rounds over these lists. A round compares
the earliest few undecided posts of each list with the later ones; a post that resembles an
earlier one is set aside at once and makes no further comparisons. A group of near copies
thus costs one comparison per member, however large it is.

Long texts hold nearly all common bigrams; two of them are compared in blocks (long_pairs.py).
A block gives every later text that resembles a head that the block has not set aside.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions.similarity import is_near
from ..session import stage_table
from .normalize import first_of_copies
from .long_pairs import long_pairs
from .skew import hot_keys, join_groups, replicated, salted

BUCKET = 6
#: Last bucket whose texts are listed by bigrams (192 characters); from it on, texts are long to each other. And slots of the bigram counts.
LONG_BUCKET, SLOTS = 32, 1 << 20
KEY = ["study_id", "post_seq"]
LIST = ["study_id", "bucket", "ch"]


def _stored(df: DataFrame) -> DataFrame:
    """df as a written table: computed once (an eager checkpoint computes its last stage twice), with sizes that joins can be planned by."""
    return stage_table(df, "near-duplicates")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _shortest(n: int) -> int:
    """The shortest text that one of n characters can resemble: a bucket below at most, and the length gap rule."""
    return max(1, (n // BUCKET - 1) * BUCKET, n - max(3, int(0.15 * n) + 1))


def _grams(text: str) -> Counter:
    return Counter(text[i:i + 2] for i in range(len(text) - 1))


def _slot(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS


def rare_bigrams(text: str, spread: np.ndarray) -> list[str]:
    """The bigrams, rarest first, of which two similar texts have at least one in common.

    Similar texts of a and b characters match m characters in blocks, with d = a + b - 2m <= (1 - ratio) * (a + b) left over. Two
    neighbouring blocks have a left-over character between them in one of the texts, so there are at most d + 1 blocks, and
    the pairs of neighbours inside blocks are common bigrams: at least m - d - 1 >= (1.5 * ratio - 1) * (a + b) - 1 of them. With all
    bigrams in one order, a common one is among the first (a - 1) - that + 1 of each text. The order is by the texts that
    have a bigram of its slot, so it needs a table of SLOTS numbers only.
    """
    n = len(text)
    common = math.ceil((1.5 * vocab.NEAR_DUP_RATIO - 1) * (n + _shortest(n)) - 1 - 1e-6)
    take, out = max(1, n - common), []
    counts = _grams(text)
    for gram in sorted(counts, key=lambda g: (spread[_slot(g)], g)):
        if take <= 0:
            break
        out.append(gram)
        take -= counts[gram]
    return out


def with_prefix(texts: DataFrame) -> DataFrame:
    """Add len, bucket and prefix, the names of the lists a text is in; two similar texts share at least one.

    Texts of up to LONG_BUCKET are in the lists of their rare bigrams. Longer ones hold nearly all common bigrams; they are
    in no list and meet each other in blocks, as do those of the last bucket of the others.
    """
    n = F.length("text")
    base = texts.select(*KEY, "text", n.alias("len"), F.floor(n / BUCKET).alias("bucket"))
    spark = texts.sparkSession

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def slots(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({_slot(g) for g in _grams(t)}) for t in texts], dtype=object)

    counted = base.where(F.col("bucket") <= LONG_BUCKET).select(F.explode(slots("text")).alias("slot")).groupBy("slot").count().toArrow()
    spread = np.zeros(SLOTS, np.int64)
    spread[counted.column("slot").to_numpy()] = counted.column("count").to_numpy()
    shared = spark.sparkContext.broadcast(spread)  # SLOTS numbers, whatever the data

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def lists(texts: pd.Series) -> pd.Series:
        return pd.Series([rare_bigrams(t, shared.value) if len(t) // BUCKET <= LONG_BUCKET else [] for t in texts], dtype=object)

    return base.withColumn("prefix", lists("text"))


def _candidates(probes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (p, w), p earlier, that share a list of p, pass the length rule and are not both long; each pair once.

    probes: KEY, bucket, len, chars (its lists); members: KEY, bucket, len, prefix.
    """
    p = probes.select(
        "study_id", F.col("post_seq").alias("p"), F.col("bucket").alias("p_bucket"), F.col("len").alias("p_len"),
        "chars", F.explode("chars").alias("ch")).withColumn(
        "bucket", F.explode(F.array(F.col("p_bucket") - 1, F.col("p_bucket"), F.col("p_bucket") + 1)))
    w = members.select("study_id", F.col("post_seq").alias("w"), "bucket", F.col("len").alias("w_len"), "prefix",
                       F.explode("prefix").alias("ch"))
    hot = hot_keys(w.groupBy(*LIST).agg(F.count(F.lit(1)).alias("n")), LIST, "n")
    pairs = salted(w, hot, LIST, "w").join(replicated(p, hot, LIST), [*LIST, "_salt"])
    gap = F.abs(F.col("p_len") - F.col("w_len"))
    return pairs.where(
        (F.col("p") < F.col("w"))
        & ((F.col("p_bucket") < LONG_BUCKET) | (F.col("bucket") < LONG_BUCKET))
        & (gap <= F.greatest(F.lit(3.0), 0.15 * F.greatest("p_len", "w_len")))
        & (F.array_intersect("chars", "prefix")[0] == F.col("ch"))).select("study_id", "p", "w", "p_bucket")


def _verified(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The pairs whose texts are similar (later text first: the measure is not symmetric)."""
    pairs = _stored(pairs)  # read three times
    vertices = vertices.where(F.col("bucket") <= LONG_BUCKET)  # the texts that are in lists
    later = vertices.select("study_id", F.col("post_seq").alias("w"), F.col("text").alias("later"))
    per_head = pairs.groupBy("study_id", "p").agg(F.count(F.lit(1)).alias("n"))
    heads = vertices.select("study_id", F.col("post_seq").alias("p"), F.col("text").alias("head"))
    # A head may have very many partners, so its rows are spread.
    texts = join_groups(pairs, heads.join(per_head, ["study_id", "p"]), ["study_id", "p"], "n", "w", how="inner")
    # Few bytes but much work: a stated number of partitions isn't merged by size, and the next join uses it.
    texts = texts.repartition(_tasks(vertices), "study_id", "w")
    return texts.join(later, ["study_id", "w"]).where(is_near("later", "head")).select(
        "study_id", "p", "w", "p_bucket")


def _minus(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    gone = found.select("study_id", F.col(column).alias("post_seq"))
    return rows.join(gone, KEY, "left_anti")


def _long_edges(vertices: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """Every long text that resembles a fresh long one which no earlier fresh one has set aside; fresh None: all are."""
    long = vertices.where(F.col("bucket") >= LONG_BUCKET).withColumns({"head": F.lit(True), "later": F.lit(True)})
    if fresh is not None:
        own = long.select(*KEY, "bucket").join(fresh, KEY, "left_semi")
        around = own.select("study_id", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")).distinct()
        heads = own.select(*KEY, F.lit(True).alias("_fresh"))
        long = long.join(around, ["study_id", "bucket"], "left_semi").join(heads, KEY, "left").withColumn(
            "head", F.coalesce("_fresh", F.lit(False))).drop("_fresh")
    return long_pairs(long, "heads", _tasks(vertices)).drop("near")


def _scan(active: DataFrame, fresh: DataFrame | None, vertices: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Compare every fresh post (None: all) with the later active ones of its lists; set matched posts aside.

    Long texts that were set aside are compared with fresh ones, too, so all edges of a long text that stays active are known.
    """
    edges: list[DataFrame] = []
    found = _stored(_long_edges(vertices, fresh))
    if not found.isEmpty():
        edges.append(found)
        active = _stored(_minus(active, found, "w"))
    done: DataFrame | None = None
    size = 1
    slim = vertices.drop("text")
    while True:
        now = slim.join(active, KEY, "left_semi")
        pool = (now if fresh is None else now.join(fresh, KEY, "left_semi")).withColumn("ch", F.explode("prefix"))
        if done is not None:
            pool = pool.join(done, [*KEY, "ch"], "left_anti")
        first = W.partitionBy(*LIST).orderBy("post_seq")
        probes = _stored(pool.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= size)
                              .select(*KEY, "bucket", "len", "ch"))
        if probes.isEmpty():
            return active, edges
        lists = probes.groupBy(*KEY, "bucket", "len").agg(F.collect_set("ch").alias("chars"))
        ordered = lists.join(slim.select(*KEY, "prefix"), KEY).withColumn(
            "chars", F.array_intersect("prefix", "chars")).drop("prefix")
        found = _stored(_verified(_candidates(ordered, now), vertices))
        if not found.isEmpty():
            edges.append(found)
            active = _stored(_minus(active, found, "w"))
        marks = probes.select(*KEY, "ch")
        done = marks if done is None else done.unionByName(marks)
        size *= 8


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = parts[0] if parts else like
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def head_of(texts: DataFrame) -> DataFrame:
    """(study_id, post_seq, head_seq) for every text; a head is its own head. Texts must be distinct."""
    vertices = _stored(with_prefix(texts))
    slim = vertices.drop("text")
    everyone = vertices.select(*KEY)
    none = everyone.limit(0).select(
        "study_id", F.col("post_seq").alias("p"), F.col("post_seq").alias("w"), F.lit(0).cast("long").alias("p_bucket"))

    def probes_of(keys: DataFrame) -> DataFrame:
        return slim.join(keys, KEY, "left_semi").withColumnRenamed("prefix", "chars")

    active, edges = _scan(everyone, None, vertices)
    while True:
        # A post set aside stays aside when it resembles a post that is still active. The others
        # were set aside by posts that were set aside themselves, and are looked at again.
        all_edges = _union(edges, none)
        held = all_edges.join(active.withColumnRenamed("post_seq", "p"), ["study_id", "p"], "left_semi")
        loose = _stored(_minus(everyone.join(active, KEY, "left_anti"), held, "w"))
        if loose.isEmpty():
            break
        found = _stored(_verified(
            _candidates(probes_of(active), slim.join(loose, KEY, "left_semi")), vertices))
        edges.append(found)
        back = _stored(_minus(loose, found, "w"))
        if back.isEmpty():
            break
        active, more = _scan(_stored(active.unionByName(back)), back, vertices)
        edges += more
    return _nearest_heads(active, _union(edges, none), vertices)


def _nearest_heads(heads: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Give each non-head the first matching head by (bucket, age); only better ones are compared."""
    slim = vertices.drop("text")
    head_p = heads.withColumnRenamed("post_seq", "p")
    known = edges.join(head_p, ["study_id", "p"], "left_semi")
    best = known.groupBy("study_id", "w").agg(F.min(F.struct("p_bucket", "p")).alias("best"))
    others = slim.join(heads, KEY, "left_anti")
    pairs = _candidates(slim.join(heads, KEY, "left_semi").withColumnRenamed("prefix", "chars"), others)
    better = pairs.join(best, ["study_id", "w"]).where(F.struct("p_bucket", "p") < F.col("best")).drop("best")
    all_known = known.select("study_id", "w", "p", "p_bucket").unionByName(
        _verified(better, vertices).select("study_id", "w", "p", "p_bucket"))
    joined = all_known.groupBy("study_id", "w").agg(F.min(F.struct("p_bucket", "p")).alias("best")).select(
        "study_id", F.col("w").alias("post_seq"), F.col("best.p").alias("head_seq"))
    return joined.unionByName(heads.select(*KEY, F.col("post_seq").alias("head_seq")))


def mark_duplicates(kept: DataFrame) -> DataFrame:
    """Flag exact and near copies as duplicate; a group carries the hash of its head."""
    marked = first_of_copies(kept, stored=True)
    firsts = marked.where("is_first")
    owner = head_of(firsts.select(*KEY, "text")).where("head_seq <> post_seq")
    hashes = firsts.select(*KEY, "exact_hash")
    moved = owner.join(hashes, KEY).join(
        hashes.select("study_id", F.col("post_seq").alias("head_seq"), F.col("exact_hash").alias("_head_hash")),
        ["study_id", "head_seq"]).select("study_id", "exact_hash", "_head_hash")
    copies = marked.groupBy("study_id", "exact_hash").agg(F.count(F.lit(1)).alias("n"))
    groups = moved.join(copies, ["study_id", "exact_hash"])
    out = join_groups(marked, groups, ["study_id", "exact_hash"], "n", "post_seq")
    duplicate = ~F.col("is_first") | F.col("_head_hash").isNotNull()
    return out.withColumn(
        "dedup_group", F.concat(F.lit("dg-"), F.substring(F.coalesce("_head_hash", "exact_hash"), 1, 8))).withColumn(
        "flags", F.when(duplicate, F.concat("flags", F.array(F.lit("duplicate")))).otherwise(F.col("flags"))).drop(
        "_head_hash")


def distinct_texts(kept: DataFrame) -> DataFrame:
    """study_id, post_seq, text of the first of each group of copies."""
    return first_of_copies(kept.select("study_id", "post_seq", "text"), stored=True).where("is_first").select("study_id", "post_seq", "text")


def candidate_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (study_id, p, w), p earlier, that share a list, pass the length rule and are not both long; and the texts with their lists."""
    vertices = _stored(with_prefix(texts))
    slim = vertices.drop("text")
    return _candidates(slim.withColumn("chars", F.col("prefix")), slim), vertices


def _long_pairs(vertices: DataFrame, mode: str) -> DataFrame:
    long = vertices.where(F.col("bucket") >= LONG_BUCKET).withColumns({"head": F.lit(True), "later": F.lit(True)})
    return long_pairs(long, mode, _tasks(vertices))


def checked_pairs(texts: DataFrame) -> DataFrame:
    """Every candidate pair (study_id, p, w), p earlier, with the result of the check: pairs of one list, and all long texts of touching buckets."""
    pairs, vertices = candidate_pairs(texts)
    own = vertices.where(F.col("bucket") <= LONG_BUCKET).select("study_id", "post_seq", "text")
    joined = pairs.select("study_id", "p", "w").join(own.withColumnsRenamed({"post_seq": "p", "text": "head"}), ["study_id", "p"]).join(
        own.withColumnsRenamed({"post_seq": "w", "text": "later"}), ["study_id", "w"])
    return joined.select("study_id", "p", "w", is_near("later", "head").alias("near")).unionByName(
        _long_pairs(vertices, "every").drop("p_bucket"))


def similar_pairs(texts: DataFrame) -> DataFrame:
    """Every similar pair (p, w) of distinct texts, p earlier."""
    pairs, vertices = candidate_pairs(texts)
    return _verified(pairs, vertices).select("study_id", "p", "w").unionByName(_long_pairs(vertices, "similar").select("study_id", "p", "w"))
