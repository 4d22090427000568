"""Topic priors and clusters of many studies at once: every round of k-means is one job for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..session import bounded_batches, stage_table
from .order_stats import order_statistics
from .topics import _labels, assign, hash_embedding, similarity_lists, topic_centroids

#: Vectors of one study that are multiplied with its centroids at once, and clusters a study can have.
BLOCK_ROWS, MOST_CLUSTERS = 512, 8


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _nested(column: pa.Array) -> list[np.ndarray]:
    """One matrix per row of a column of lists of vectors; an empty one where it is null."""
    return [_matrix(x.values) if x.is_valid and len(x.values) else np.empty((0, 0)) for x in column]


def cluster_count(n: Column, min_size: int) -> Column:
    """Clusters of a group of n rows: one per min_size rows, 2 to MOST_CLUSTERS, but not more than rows."""
    wanted = F.floor(n / F.lit(max(min_size, 1)))
    return F.least(n, F.greatest(F.lit(2), F.least(F.lit(MOST_CLUSTERS), wanted))).cast("int")


def _starts(rows: DataFrame, sizes: DataFrame, group: str, seq: str, min_size: int) -> DataFrame:
    """group, cluster, centroid: the vectors at evenly spaced places of each group in the order of seq."""
    def at(i: int):
        return lambda n: F.least(n - 1, F.lit(i) * F.greatest(F.lit(1), F.floor(n / cluster_count(n, min_size))))

    picked = order_statistics(rows, seq, {f"p{i}": at(i) for i in range(MOST_CLUSTERS)}, by=group).join(sizes, group)
    listed = picked.select(group, "k", F.posexplode(F.array(*[f"p{i}" for i in range(MOST_CLUSTERS)])).alias("cluster", seq)).where("cluster < k")
    # At most eight rows per group.
    return listed.join(rows.select(group, seq, "vector"), [group, seq]).select(group, "cluster", F.col("vector").alias("centroid"))


def _packed(centroids: DataFrame, group: str, name: str) -> DataFrame:
    """group and its centroids as one list in the order of their numbers, which have no gaps."""
    return centroids.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("c")).select(
        group, F.transform("c", lambda x: x["centroid"]).alias(name))


def kmeans_by(vectors: DataFrame, group: str, seq: str, min_size: int = vocab.MIN_CLUSTER_SIZE, iters: int = 25) -> DataFrame:
    """group, seq, cluster: cosine k-means inside every group, with the starting rows, rounds and ties of topics.kmeans.

    Vectors are packed once into blocks of bounded size, so a group with a third of all rows is as many blocks as it needs, and a
    block meets its group's few centroids by a join on the group. A round sums by (group, cluster, dimension) and counts rows that changed their cluster;
    groups without such rows are done and take no part in later rounds. The jobs of a round don't depend on the number of groups, nothing of a group reaches the driver.
    Vectors of a group have one length; rows without vector, seq or group take no part. An empty table gives no rows.
    """
    rows = stage_table(vectors.select(group, seq, "vector").where(F.col(group).isNotNull() & F.col(seq).isNotNull() & F.col("vector").isNotNull()), "study-vectors")
    kind = rows.schema[group].dataType.simpleString()
    sizes = stage_table(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("k", cluster_count(F.col("n"), min_size)), "study-sizes")
    # Groups are few next to rows: blocks by hash need only the largest group's size.
    blocks = max(1, -(-(sizes.agg(F.max("n")).first()[0] or 1) // BLOCK_ROWS))
    packed = stage_table(rows.groupBy(group, F.pmod(F.xxhash64(seq), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(seq, "vector")).alias("v")).select(group, F.transform("v", lambda x: x[seq]).alias("seqs"), F.transform("v", lambda x: x["vector"]).alias("v")),
        "study-blocks")
    current = stage_table(_starts(rows, sizes, group, seq, min_size), "study-centroids")
    before, used, open_ = None, current, None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [group, "cluster", "sums", "moved"]
        for b in batches:
            out: list[tuple] = []
            for key, vectors_, now, old in zip(b.column(group).to_pylist(), *(_nested(b.column(c)) for c in ("v", "now", "old"))):
                label = _labels(vectors_, now)
                was = _labels(vectors_, old) if len(old) else np.zeros_like(label)
                for c in np.unique(label):
                    out.append((key, int(c), vectors_[label == c].sum(0).tolist(), int((label != was)[label == c].sum())))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [b.schema.field(group).type, pa.int32(), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for _ in range(iters):
        now = _packed(current, group, "now")
        joined = (packed if open_ is None else packed.join(open_, group, "left_semi")).join(now, group)
        joined = joined.withColumn("old", F.lit(None).cast("array<array<double>>")) if before is None else joined.join(_packed(before, group, "old"), group)
        parts = stage_table(joined.select(group, "v", "now", "old").mapInArrow(sums, f"{group} {kind}, cluster int, sums array<double>, moved long"), "study-sums")
        used = current
        open_ = stage_table(parts.groupBy(group).agg(F.sum("moved").alias("moved")).where("moved > 0").select(group), "study-open")
        if open_.isEmpty():
            break
        # Sums over tasks depend on their order in the last bits; labels must not.
        added = parts.join(open_, group, "left_semi").select(group, "cluster", F.posexplode("sums").alias("pos", "x")).groupBy(group, "cluster", "pos").agg(
            F.round(F.sum("x"), 9).alias("x")).groupBy(group, "cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s"))
        total = F.transform("s", lambda p: p["x"])
        length = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
        means = added.select(group, "cluster", F.transform(total, lambda x: F.when(length > 0, x / length).otherwise(x)).alias("mean"))
        before, current = current, stage_table(current.join(means, [group, "cluster"], "left").select(
            group, "cluster", F.coalesce("mean", "centroid").alias("centroid")), "study-centroids")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = [_labels(v, c) for v, c in zip(_nested(b.column("v")), _nested(b.column("now")))]
            counts = [len(x) for x in labels]
            at = pa.array(np.repeat(np.arange(b.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [b.column(group).take(at), b.column("seqs").flatten(), pa.array(np.concatenate([np.empty(0, np.int64), *labels]).astype(np.int64))],
                names=[group, seq, "cluster"])

    return packed.join(_packed(used, group, "now"), group).select(group, "seqs", "v", "now").mapInArrow(
        labelled, f"{group} {kind}, {seq} {rows.schema[seq].dataType.simpleString()}, cluster long")


def emerging_by(labelled: DataFrame, group: str, seq: str, text: str, min_size: int = vocab.MIN_CLUSTER_SIZE) -> DataFrame:
    """group, cluster, new_topic_id, size, sample_texts: clusters with at least min_size members, numbered in label order per group, with five texts."""
    sizes = labelled.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    named = sizes.withColumn("new_topic_id", F.concat(
        F.lit("new:c"), (F.row_number().over(W.partitionBy(group).orderBy("cluster")) - 1).cast("string")))
    first = W.partitionBy(group, "cluster").orderBy(seq)
    samples = labelled.withColumn("_rn", F.row_number().over(first)).where("_rn <= 5").groupBy(group, "cluster").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.substring(text, 1, 50).alias("s")))).alias("p"))
    return named.join(samples, [group, "cluster"]).select(group, "cluster", "new_topic_id", "size", F.col("p.s").alias("sample_texts"))


def priors_by(texts: DataFrame, group: str, seq: str, centroids: DataFrame | None = None, threshold: float = vocab.ASSIGN_THRESHOLD,
              min_size: int = vocab.MIN_CLUSTER_SIZE, embed=hash_embedding) -> tuple[DataFrame, DataFrame]:
    """The priors stage for the texts (group, seq, text) of all groups in one run; clusters never cross groups.

    Returns (group, seq, topics, new_topic), one row for every text with group and seq, and the candidates for new topics (group, new_topic_id, size, sample_texts), both
    equal to what topics.priors gives for each group alone.
    """
    texts = texts.where(F.col(group).isNotNull() & F.col(seq).isNotNull())
    bounded_batches(texts.sparkSession)
    vectors = stage_table(texts.select(group, seq, "text", embed(F.col("text")).alias("vector")), "embedded")
    centroids = topic_centroids(texts.sparkSession) if centroids is None else centroids
    assigned = stage_table(assign(similarity_lists(vectors, centroids, [group, seq]), [group, seq], threshold), "assigned")
    rest = stage_table(vectors.join(assigned.where(F.size("topics") == 0).select(group, seq), [group, seq], "left_semi"), "unassigned")
    labels = stage_table(kmeans_by(rest, group, seq, min_size).join(rest.select(group, seq, "text"), [group, seq]), "clustered")
    named = stage_table(emerging_by(labels, group, seq, "text", min_size), "new-topics")
    own = labels.join(named.select(group, "cluster", F.col("new_topic_id").alias("new_topic")), [group, "cluster"]).select(group, seq, "new_topic")
    return assigned.join(own, [group, seq], "left"), named.drop("cluster")
