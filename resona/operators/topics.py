"""Vectors, topic assignment by similarity, and clustering of what no topic fits."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions import text as X
from ..functions import vectors as V
from ..rules import DEFAULT, Rules
from ..session import bounded_batches, stage_table
from .order_stats import order_statistics


#: Characters whose trigrams are counted at once, and hashes of trigrams that a worker keeps.
EMBED_CHARS, KEPT_GRAMS = 1 << 17, 1 << 18


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Hash embedding of unit length: signed counts of character trigrams of the lower-cased text without blanks, row by row.

    A trigram adds to the dimension that its hash names, with the sign of the hash's highest bit; shorter texts are one gram.
    """
    def run(texts: pa.Array) -> pa.Array:
        rows = _hashed([t or "" for t in texts.to_pylist()], dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(rows.reshape(-1)))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(X.drop_spaces(F.lower(text)))


@lru_cache(maxsize=KEPT_GRAMS)
def _head(code: int) -> int:
    """First four bytes of the digest of a trigram, given as three code points plus one (0 for none) of 21 bits."""
    points = (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF)
    return int.from_bytes(md5("".join(chr(p - 1) for p in points if p).encode()).digest()[:4], "big")


def _hashed(squeezed: list[str], dim: int) -> np.ndarray:
    """The embeddings of texts without blanks, as rows; texts are taken together up to EMBED_CHARS characters."""
    out, lo = np.empty((len(squeezed), dim)), 0
    while lo < len(squeezed):
        hi, chars = lo + 1, len(squeezed[lo])
        while hi < len(squeezed) and chars + len(squeezed[hi]) <= EMBED_CHARS:
            chars, hi = chars + len(squeezed[hi]), hi + 1
        out[lo:hi], lo = _hashed_part(squeezed[lo:hi], dim), hi
    return out


def _hashed_part(texts: list[str], dim: int) -> np.ndarray:
    # Three places behind every text are empty, so that a gram never runs into the next one.
    n = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(n + 3) - (n + 3)
    row = np.repeat(np.arange(len(texts)), n + 3)
    at = np.arange(len(row)) - starts[row]
    points = np.zeros(len(row), np.uint64)
    points[at < n[row]] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4") + np.uint64(1)
    here = np.flatnonzero(at < np.maximum(1, n - 2)[row])
    grams, distinct = pd.factorize(points[here] << np.uint64(42) | points[here + 1] << np.uint64(21) | points[here + 2])
    heads = np.fromiter(map(_head, distinct.tolist()), np.int64, len(distinct))
    signs = np.where(heads >= 2 ** 31, 1.0, -1.0)
    sums = np.bincount(row[here] * dim + (heads % dim)[grams], signs[grams], len(texts) * dim).reshape(-1, dim)
    size = np.sqrt((sums * sums).sum(1))
    return sums / np.where(size == 0, 1.0, size)[:, None]


def hash_vectors(texts: DataFrame, key: list[str], dim: int = 256) -> DataFrame:
    """Sparse hash embedding (key, dim, value), unit length. Nothing is moved between partitions."""
    bounded_batches(texts.sparkSession)
    dense = texts.select(*key, hash_embedding(F.col("text"), dim).alias("_v"))
    return dense.select(*key, F.posexplode("_v").alias("dim", "value")).where("value <> 0")


def embed_with(texts: DataFrame, key: list[str], model, quality: str) -> DataFrame:
    """Dense vectors from a user function (pandas Series of texts -> list of vectors), in Arrow batches."""
    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(list(model(text)))

    return texts.select(*key, run("text").alias("vector"), F.lit(quality).alias("embed_quality"))


def topic_centroids(spark: SparkSession, dim: int = 256, rules: Rules = DEFAULT) -> DataFrame:
    """Centroids (topic, centroid) of the topics of the rules: one row each."""
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(f"{t} {d}").alias("text")) for t, d in rules.topics.items()])
    return spark.range(1).select(F.inline(rows)).select(
        "topic", hash_embedding(F.col("text"), dim).alias("centroid"))


#: Centroids that travel together next to a vector, and numbers in all of them up to which they are sent to every task (64 MB).
CENTROID_BLOCK, BROADCAST_NUMBERS = 256, 8_000_000
#: Numbers in the centroids of one block up to which they are part of the tasks (4 MB), vectors that are compared with them at once.
DIRECT_NUMBERS, SIMILARITY_ROWS = 500_000, 1024


def similarity_lists(vectors: DataFrame, centroids: DataFrame, key: list[str]) -> DataFrame:
    """key and sims, the list of (topic, similarity) of every vector (key, vector) with the centroids (topic, centroid).

    Centroids are packed in blocks that a vector meets one by one, one row for each. Their numbers are counted. A single block of up to
    DIRECT_NUMBERS goes with the tasks, which compare whole batches with it. Up to BROADCAST_NUMBERS the blocks are sent to
    all tasks and vectors stay where they are; beyond it every vector is sent to the blocks, spread over as many keys as there are blocks.
    """
    bounded_batches(vectors.sparkSession)
    # Written once, as they may be means over all rows; counted before any is collected.
    centroids = stage_table(centroids.select("topic", "centroid"), "centroids")
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("centroid")), F.lit(0)).alias("numbers")).first()
    if 0 < size.n <= CENTROID_BLOCK and size.numbers <= DIRECT_NUMBERS:
        rows = centroids.orderBy("topic").collect()
        kind = centroids.schema["topic"].dataType
        topics = F.array(*[F.lit(r.topic).cast(kind) for r in rows])
        found = _similarities([r.centroid for r in rows])(F.col("vector"))
        return vectors.select(*key, F.arrays_zip(topics.alias("topic"), found.alias("similarity")).alias("sims"))
    blocks = max(1, -(-size.n // CENTROID_BLOCK))
    packed = centroids.groupBy(F.pmod(F.xxhash64("topic"), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("topic", F.col("centroid").alias("c")))).alias("_packed"))
    sims = F.transform("_packed", lambda p: F.struct(
        p["topic"].alias("topic"), V.cosine(F.col("vector"), p["c"]).alias("similarity")))
    rows = vectors.select(*key, "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return rows.join(F.broadcast(packed) if size.numbers <= BROADCAST_NUMBERS else packed, "_block").select(*key, sims.alias("sims"))


def dense_similarity(vectors: DataFrame, centroids: DataFrame, key: list[str]) -> DataFrame:
    """Cosine of every vector (key, vector) with every centroid (topic, centroid): one row per pair, also where nothing is shared."""
    return similarity_lists(vectors, centroids, key).select(*key, F.inline("sims"))


def _similarities(centroids: list[list[float | None] | None]):
    """Vector -> its cosines with these centroids, added up from the first component to the last as vectors.cosine does; null where a
    vector or centroid is null, holds a null or has another length."""
    whole = [c is not None and None not in c for c in centroids]
    by_size = {d: [i for i, c in enumerate(centroids) if whole[i] and len(c) == d] for d in {len(c) for c, w in zip(centroids, whole) if w}}
    packed = {d: np.array([centroids[i] for i in at], float).reshape(len(at), d) for d, at in by_size.items()}

    def run(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        out, known = np.zeros((n, len(centroids))), np.zeros((n, len(centroids)), bool)
        vectors = vectors.cast(pa.list_(pa.float64()))
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        values = vectors.flatten()
        firsts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        good = lengths >= 0
        if values.null_count:
            gaps = np.concatenate([[0], np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False))])
            good &= gaps[firsts + np.maximum(lengths, 0)] == gaps[firsts]
        flat = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        for d, matrix in packed.items():
            at = np.flatnonzero(good & (lengths == d))
            for lo in range(0, len(at), SIMILARITY_ROWS):
                part = at[lo:lo + SIMILARITY_ROWS]
                cell = np.ix_(part, by_size[d])
                out[cell], known[cell] = cosines(flat[firsts[part][:, None] + np.arange(d)], matrix), True
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(centroids), pa.int32()), pa.array(out.reshape(-1), mask=~known.reshape(-1)))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))


def cosines(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows. Every sum runs over the components in order, so it does not depend on the rows beside it."""
    across = np.ascontiguousarray(vectors.T)
    dots, own, size = np.zeros((len(centroids), len(vectors))), np.zeros(len(vectors)), np.zeros(len(centroids))
    with np.errstate(all="ignore"):
        for x, c in zip(across, centroids.T):
            dots += c[:, None] * x
            own += x * x
            size += c * c
        own, size = np.sqrt(own), np.sqrt(size)
        return (dots / (np.where(own == 0, 1.0, own) * np.where(size == 0, 1.0, size)[:, None])).T


def assign(similarities: DataFrame, key: list[str], threshold: float | Column = vocab.ASSIGN_THRESHOLD,
           most: int = 4) -> DataFrame:
    """Per row the topics at or above the threshold, best first, at most `most`; empty when none fits.

    similarities: one row per pair, or similarity_lists, whose hits are picked before anything moves.
    """
    limit = F.round(threshold, 12) if isinstance(threshold, Column) else F.lit(threshold)

    def hit(topic: Column, similarity: Column) -> Column:
        # Compared and ordered by 12 digits: sums of products differ in the last bits with the order of addition.
        rounded = F.round(similarity, 12)
        return F.when(rounded >= limit, F.struct(rounded.alias("s"), topic.alias("topic")))

    if "sims" in similarities.columns:
        hits = F.flatten(F.collect_list(F.array_compact(F.transform("sims", lambda x: hit(x["topic"], x["similarity"])))))
    else:
        # One row per key holds at most one entry per topic, so the list is bounded by the topic count.
        hits = F.collect_list(hit(F.col("topic"), F.col("similarity")))
    return (similarities.groupBy(*key).agg(F.sort_array(hits, asc=False).alias("hits"))
            .select(*key, F.slice(F.col("hits.topic"), 1, most).alias("topics")))


def mean_centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per value of `by`, summed per dimension before the shuffle."""
    parts = vectors.select(by, F.posexplode("vector").alias("pos", "x"))
    means = parts.groupBy(by, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select(
        F.col(by).alias("topic"), F.col("p.m").alias("centroid"))


def cluster_count(n: int, min_size: int = vocab.MIN_CLUSTER_SIZE) -> int:
    return max(2, min(8, n // max(min_size, 1) or 2))


def _labels(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the most similar centroid per row, the lowest on a tie."""
    size = np.linalg.norm(centroids, axis=1)
    own = np.linalg.norm(matrix, axis=1)
    scale = np.outer(np.where(own == 0, 1.0, own), np.where(size == 0, 1.0, size))
    # By 12 digits: sums of products differ in the last bits with the order of addition.
    return np.round(matrix @ centroids.T / scale, 12).argmax(axis=1)


def _round(centroids: np.ndarray, before: np.ndarray | None):
    """Per task: sums per (cluster, dimension) and how many rows changed their cluster."""
    def run(batches):
        total, moved = {}, {}
        for pdf in batches:
            if not len(pdf):
                continue
            matrix = np.stack(pdf["vector"].to_numpy())
            now = _labels(matrix, centroids)
            old = np.zeros_like(now) if before is None else _labels(matrix, before)
            for c in np.unique(now).tolist():
                total[c] = total.get(c, 0.0) + matrix[now == c].sum(axis=0)
                moved[c] = moved.get(c, 0) + int((now != old)[now == c].sum())
        for c, sums in total.items():
            yield pd.DataFrame({"cluster": c, "pos": range(len(sums)), "x": sums, "moved": moved[c]})

    return run


def _cluster_of(centroids: np.ndarray) -> Column:
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(_labels(np.stack(vectors.to_numpy()), centroids))

    return F.pandas_udf(run, T.LongType())(F.col("vector"))


def kmeans(vectors: DataFrame, seq: str, k: int, iters: int = 25) -> tuple[DataFrame, list[list[float]]]:
    """Cosine k-means from evenly spaced starting rows; returns labelled vectors and centroids.

    Each round is one pass: labels under the old and new centroids give the number of changed
    rows, and sums per (cluster, dimension) give the next centroids. Only k x dimension numbers
    (k is at most 8) reach the driver; labels are never stored.
    """
    rows = vectors.select(seq, "vector").withColumn("_all", F.lit(1)).persist()
    try:
        n = rows.count()
        if n == 0:
            return vectors.withColumn("cluster", F.lit(None).cast("long")), []
        k = min(k, n)
        places = list(range(0, n, max(1, n // k)))[:k]
        starts = order_statistics(rows, seq, {f"p{i}": _fixed_place(p) for i, p in enumerate(places)}, by="_all").first()
        ids = [starts[f"p{i}"] for i in range(len(places))]
        found = {r[0]: r[1] for r in rows.where(F.col(seq).isin(ids)).select(seq, "vector").collect()}
        current, before, used = np.array([found[i] for i in ids], dtype=float), None, None
        for _ in range(iters):
            sums = (rows.select("vector").mapInPandas(_round(current, before), "cluster long, pos int, x double, moved long")
                    .groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.sum("moved").alias("moved")).collect())
            used = current
            if not any(r.moved for r in sums if r.pos == 0):
                break
            after = current.copy()
            for r in sums:
                after[r.cluster, r.pos] = r.x
            for c in {r.cluster for r in sums}:
                # Sums over tasks depend on their order in the last bits; labels must not.
                after[c] = np.round(after[c], 9)
                after[c] /= np.linalg.norm(after[c]) or 1.0
            before, current = current, after
        return vectors.withColumn("cluster", _cluster_of(used)), current.tolist()
    finally:
        rows.unpersist()


def _fixed_place(p: int):
    return lambda _n: F.lit(p)


def emerging(labelled: DataFrame, seq: str, text: str, min_size: int = vocab.MIN_CLUSTER_SIZE) -> DataFrame:
    """Clusters with at least min_size members, numbered in label order, with five sample texts."""
    return _emerging(labelled, seq, text, min_size).drop("cluster")


def _emerging(labelled: DataFrame, seq: str, text: str, min_size: int) -> DataFrame:
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    # At most 8 clusters, so this window is over 8 rows.
    named = sizes.withColumn("new_topic_id", F.concat(
        F.lit("new:c"), (F.row_number().over(W.orderBy("cluster")) - 1).cast("string")))
    w = W.partitionBy("cluster").orderBy(seq)
    samples = (labelled.withColumn("_rn", F.row_number().over(w)).where("_rn <= 5").groupBy("cluster")
               .agg(F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.substring(text, 1, 50).alias("s")))).alias("p")))
    return named.join(samples, "cluster").select("cluster", "new_topic_id", "size", F.col("p.s").alias("sample_texts"))


def priors(texts: DataFrame, seq: str, centroids: DataFrame | None = None, threshold: float = vocab.ASSIGN_THRESHOLD,
           min_size: int = vocab.MIN_CLUSTER_SIZE, embed=hash_embedding) -> tuple[DataFrame, DataFrame]:
    """The priors stage for the texts (seq, text) of one study: embed, assign, cluster what no topic fits.

    Returns (seq, topics, new_topic), one row for every text, and the candidates for new topics (new_topic_id, size, sample_texts). A text has
    topics, or the new topic of its cluster if that has min_size members, or neither. embed: text column -> vector column.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    vectors = stage_table(texts.select(seq, "text", embed(F.col("text")).alias("vector")), "embedded")
    centroids = topic_centroids(spark) if centroids is None else centroids
    assigned = stage_table(assign(similarity_lists(vectors, centroids, [seq]), [seq], threshold), "assigned")
    rest = stage_table(vectors.join(assigned.where(F.size("topics") == 0).select(seq), seq, "left_semi"), "unassigned")
    n = rest.count()
    if n == 0:
        return assigned.withColumn("new_topic", F.lit(None).cast("string")), spark.createDataFrame(
            [], "new_topic_id string, size long, sample_texts array<string>")
    labelled = stage_table(kmeans(rest, seq, cluster_count(n, min_size))[0].drop("vector"), "clustered")
    named = stage_table(_emerging(labelled, seq, "text", min_size), "new-topics")
    # At most 8 clusters.
    own = labelled.join(F.broadcast(named.select("cluster", F.col("new_topic_id").alias("new_topic"))), "cluster").select(seq, "new_topic")
    return assigned.join(own, seq, "left"), named.drop("cluster")


def baseline_thresholds(train: DataFrame) -> DataFrame:
    """Per study: P10 of the best similarity of relevant rows, P25 of the best gold-topic similarity."""
    relevant = order_statistics(train.where("relevant"), "best", {"relevance": lambda n: F.floor(n * F.lit(0.10))})
    topics = order_statistics(train, "gold_best", {"topics": lambda n: F.floor(n * F.lit(0.25))})
    return relevant.join(topics, "study_id", "full_outer").select(
        "study_id", F.coalesce("relevance", F.lit(0.30)).alias("relevance"),
        F.coalesce("topics", F.lit(0.30)).alias("topics"))


def baseline_rows(similarities: DataFrame, key: list[str]) -> DataFrame:
    """Best similarity over all topics, and over the gold topics (0 when none is a centroid)."""
    gold = F.when(F.array_contains("gold_topics", F.col("topic")), F.col("similarity"))
    return similarities.groupBy(*key).agg(
        F.max("similarity").alias("best"),
        F.max(F.when(F.size("gold_topics") > 0, F.lit(True))).alias("_has_gold"), F.max(gold).alias("gold_best"),
    ).withColumn("gold_best", F.when(F.col("_has_gold"), F.coalesce("gold_best", F.lit(0.0)))).drop("_has_gold")
