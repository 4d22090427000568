"""Exact k-means on integer vectors stored as bit planes: dot products are weighted popcounts of ANDed planes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .knn import finite
from .registry import query, table

SCALE = 1024
#: Components of a vector, one bit of each in a plane.
WIDTH = 64
CLUSTERS, ROUNDS = 8, 10
#: With at most so many planes every distance fits a 64-bit number; beyond it sums are Python integers.
SMALL_PLANES = 28
LONG = 2 ** 63 - 1


def integers(column: pa.Array) -> np.ndarray:
    """Rows floor(1024 * x) of vectors of WIDTH components, as longs, or as Python integers where they are too large."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, WIDTH)
    if not flat.size or np.abs(flat).max() < 2.0 ** 50:
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([[math.floor(x * SCALE) if abs(x) < 2.0 ** 50 else int(x) * SCALE for x in row] for row in flat.tolist()], dtype=object)


def weights(planes: int) -> list[int]:
    """Value of a bit in each plane of two's complement numbers."""
    return [1 << i for i in range(planes - 1)] + [-(1 << (planes - 1))]


def pack(rows: np.ndarray, planes: int) -> np.ndarray:
    """rows of WIDTH integers -> for each row one uint64 per plane, bit c of plane i being bit i of component c."""
    out = np.empty((len(rows), planes), np.uint64)
    for i in range(planes):
        bits = ((rows >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def unpack_counts(packed: np.ndarray) -> np.ndarray:
    """Number of rows whose component has the bit set, by plane and component."""
    bits = np.unpackbits(np.ascontiguousarray(packed).astype("<u8").view(np.uint8).reshape(*packed.shape, 8), axis=2, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def dots(packed: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products of every row of packed with every row of other, by popcounts of ANDed planes."""
    planes = packed.shape[1]
    w = np.array(weights(planes), np.int64 if planes <= SMALL_PLANES else object)
    out = np.zeros((len(packed), len(other)), w.dtype)
    for k, row in enumerate(other):
        for i in np.flatnonzero(row):
            out[:, k] += np.bitwise_count(packed & row[i]).astype(w.dtype) @ w * w[i]
    return out


def norms(packed: np.ndarray) -> np.ndarray:
    """Inner product of every row with itself."""
    planes = packed.shape[1]
    w = np.array(weights(planes), np.int64 if planes <= SMALL_PLANES else object)
    out = np.zeros(len(packed), w.dtype)
    for i in range(planes):
        out += np.bitwise_count(packed & packed[:, i:i + 1]).astype(w.dtype) @ w * w[i]
    return out


def nearest(packed: np.ndarray, own: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equally near ones) and the squared distance to it; own: the rows' norms."""
    planes = packed.shape[1]
    small = planes <= SMALL_PLANES
    rows = np.array(centroids, np.int64 if small else object)
    squares = (rows * rows).sum(1)
    distances = own[:, None] - 2 * dots(packed, pack(rows, planes)) + squares[None]
    best = distances.argmin(1)
    return best, distances[np.arange(len(best)), best]


def _planes_needed(low: float, high: float) -> int:
    """Planes that hold floor(1024 * x) for all x between the two."""
    ends = integers(pa.array([[low, high] * (WIDTH // 2)], pa.list_(pa.float64())))[0]
    return max(int(e if e >= 0 else ~e).bit_length() for e in ends[:2].tolist()) + 1


class Batches:
    """Batches of a stored plane table as arrays."""

    def __init__(self, planes: int):
        self.planes = planes

    def read(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        packed = np.frombuffer(b"".join(b.column("planes").to_pylist()), "<u8").reshape(-1, self.planes)
        own = b.column("norm").to_pylist()
        return packed, np.array([int(x) for x in own], np.int64 if self.planes <= SMALL_PLANES else object)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: k-means of vectors (vec_id, vec) in whole numbers.

    Vectors that are null, have another number of components than WIDTH or a null or non-finite one take no part. The others are turned into
    floor(1024 * x) and stored as bit planes once; every round reads the planes only. A task adds up, by cluster, how many of its vectors have each bit
    set, so a round moves one row per task, cluster and plane, and k * planes rows reach the driver. The first centroids are the k vectors with the smallest
    sha256 of `3:<vec_id>` (repeated ids by their planes, rows without id last); with fewer vectors there are fewer
    clusters, with none no rows. Repeated rows count each. Ties go to the smaller cluster. Distances and their sums over 2**63 - 1 are reported as that number,
    assignments and centroids stay exact for components of any size.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).where(
        finite("vec") & (F.size("vec") == WIDTH))
    ends = kept.agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).first()
    if ends.low is None:
        return kept.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    planes = _planes_needed(ends.low, ends.high)
    batch = Batches(planes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pack(integers(b.column("vec")), planes)
            raw = made.astype("<u8").tobytes()
            width = planes * 8
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([raw[i * width:(i + 1) * width] for i in range(len(made))], pa.binary()),
                 pa.array([str(x) for x in norms(made).tolist()], pa.string())], names=["vec_id", "planes", "norm"])

    rows = stage_table(kept.mapInArrow(packed, "vec_id long, planes binary, norm string"), "planes")
    order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(order.alias("h"), "planes").orderBy(F.col("h").asc_nulls_last(), "planes").limit(k).collect()
    w = weights(planes)

    def whole(counts: np.ndarray) -> list[int]:
        """Sums by component from counts by plane and component."""
        return [sum(x * int(n) for x, n in zip(w, column)) for column in counts.T]

    centroids = [whole(unpack_counts(np.frombuffer(bytes(r.planes), "<u8").reshape(1, planes))) for r in first]

    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(centroids), np.int64)
            counts = np.zeros((len(centroids), planes, WIDTH), np.int64)
            for b in batches:
                if b.num_rows:
                    part, own = batch.read(b)
                    best, _ = nearest(part, own, centroids)
                    for c in np.unique(best):
                        n[c] += (best == c).sum()
                        counts[c] += unpack_counts(part[best == c])
            at = [(c, i) for c in np.flatnonzero(n) for i in range(planes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c) for c, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), pa.array([int(n[c]) for c, _ in at], pa.int64()),
                 pa.array([counts[c, i].tolist() for c, i in at], pa.list_(pa.int64()))], names=["cluster", "plane", "n", "counts"])

        found = rows.mapInArrow(sums, "cluster int, plane int, n long, counts array<long>").groupBy("cluster", "plane").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("counts")[i]) for i in range(WIDTH)]).alias("counts")).collect()
        counts, size = np.zeros((len(centroids), planes, WIDTH), object), {}
        for r in found:
            counts[r.cluster, r.plane], size[r.cluster] = r.counts, r.n
        centroids = [[s // size[c] for s in whole(counts[c])] if c in size else centroids[c] for c in range(len(centroids))]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best, distance = nearest(*batch.read(b), centroids)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array([min(int(d), LONG) for d in distance], pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    out = stage_table(rows.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "planes-assigned")
    # At most k rows.
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = F.create_map(*[x for c, s in inertia.items() for x in (F.lit(c), F.lit(min(s, LONG)))])
    digest = F.create_map(*[x for c in inertia for x in (F.lit(c), F.lit(sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))])
    return out.select("vec_id", "cluster", "distance", of[F.col("cluster")].cast("long").alias("cluster_inertia"),
                      F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))


def _oracle(rounds: int) -> str:
    """One pair of common tables per round: nearest centroids, then their means rounded down."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select rid, any_value(vec_id) as vec_id, min(d) as distance, arg_min(c, {{'d': d, 'c': c}}) as c from (
    select rid, vec_id, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from e, c{i}) group by rid)""")
        if i < rounds:
            steps.append(f"""
s{i} as (select c, j, sum(v[j])::hugeint as s, count(*)::hugeint as n from (select c, v, unnest(range(1, 65)) as j from a{i} join e using (rid)) group by c, j),
c{i + 1} as materialized (
  select c{i}.c, coalesce(x.m, c{i}.m) as m from c{i} left join (
    select c, list(((s - ((s % n + n) % n)) // n)::bigint order by j) as m from s{i} group by c) x on x.c = c{i}.c)""")
    return """
with e as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int as c, v as m from e order by sha256('3:' || vec_id) limit 8),""" + ",".join(steps) + f""",
i as (select c, sum(distance)::bigint as s from a{rounds} group by c)
select vec_id, a.c as cluster, distance, i.s as cluster_inertia, (select sum(s)::bigint from i) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} a join i on i.c = a.c join c{rounds} m on m.c = a.c
"""


@query("op13_bit_plane_kmeans", _oracle(ROUNDS))
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return clusters(rows.select("vec_id", F.col("embedding").alias("vec")))
