"""Exact top-k search by inner product: a k-nearest-neighbour join over Voronoi cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .registry import query, table

SCALE = 1024.0
#: At most so many pivots; at most so many queries in a block and candidates in a slice that meet in one task.
PIVOTS, QUERY_BLOCK, SLICE = 64, 4096, 32768
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1


def finite(vec: str) -> F.Column:
    """Whether a vector is there and has only finite components."""
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows floor(1024 * x) as doubles, shorter vectors filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64) if len(column) else np.empty(0, np.int64)
    flat = np.floor(SCALE * np.asarray(column.flatten(), dtype=np.float64))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 2**53 in Python integers, limited to what a long holds."""
    if not queries.size or not rows.size or np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < EXACT:
        return queries @ rows.T
    as_int = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(as_int(queries) @ as_int(rows).T, -LONG - 1, LONG)


@dataclass
class Cells:
    """Pivots in the space where nearest means highest inner product, and what is known of the rows around each.

    A row x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query q becomes (q, 0): then |q - x|^2 = |q|^2 + M^2 - 2 q.x.
    """

    pivots: np.ndarray
    norm: float

    def lift(self, rows: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0.0, self.norm ** 2 - (rows * rows).sum(1)))
        return np.hstack([rows, extra[:, None]])

    def nearest(self, rows: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        lifted = self.lift(rows, query)
        square = (lifted ** 2).sum(1)[:, None] + (self.pivots ** 2).sum(1)[None] - 2 * lifted @ self.pivots.T
        cell = square.argmin(1)
        return cell.astype(np.int32), np.sqrt(np.maximum(0.0, square[np.arange(len(rows)), cell]))


def _pivots(rows: DataFrame, vec: str, width: int, norm: float, n: int) -> Cells:
    """Distinct vectors of a bounded sample: the rows with the smallest hash of their id."""
    sample = rows.select(vec, F.xxhash64("vec_id", F.lit("pivot")).alias("_h")).orderBy("_h").limit(4 * n).toArrow()
    lifted = Cells(np.empty((0, width + 1)), norm).lift(matrix(sample.column(vec), width), False)
    return Cells(np.unique(lifted, axis=0)[:n] if len(lifted) <= n else _spread(np.unique(lifted, axis=0), n), norm)


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those before it."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        chosen.append(int(far.argmax()))
    return points[chosen]


def _place(rows: DataFrame, vec: str, width: int, cells: Cells, query: bool) -> DataFrame:
    """Rows with their nearest pivot and the distance to it."""
    kind = rows.schema[vec].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = cells.nearest(matrix(b.column(vec), width), query) if b.num_rows else (np.empty(0, np.int32), np.empty(0))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column(vec), pa.array(cell), pa.array(dist)],
                                             names=["vec_id", vec, "cell", "dist"])

    return rows.select("vec_id", vec).mapInArrow(run, f"vec_id long, `{vec}` {kind}, cell int, dist double")


def _least(placed: DataFrame, k: int) -> dict[int, list[tuple[float, int]]]:
    """Per cell the k smallest distances to its pivot over distinct ids, with the ids, from k per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cell, dist, ids = (b.column(c).to_numpy() for c in ("cell", "dist", "vec_id"))
            for c in np.unique(cell):
                old = kept.get(int(c), (np.empty(0), np.empty(0, np.int64)))
                near, own = np.concatenate([old[0], dist[cell == c]]), np.concatenate([old[1], ids[cell == c]])
                order = np.argsort(near, kind="stable")
                order = order[np.sort(np.unique(own[order], return_index=True)[1])[:k]]
                kept[int(c)] = near[order], own[order]
        rows = [(c, d, i) for c, (near, own) in kept.items() for d, i in zip(near.tolist(), own.tolist())]
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())],
                                         names=["cell", "dist", "vec_id"])

    parts = placed.select("cell", "dist", "vec_id").mapInArrow(run, "cell int, dist double, vec_id long")
    whole = parts.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist")).groupBy("cell").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("dist", "vec_id"))), 1, k).alias("near"))
    return {r.cell: [(x.dist, x.vec_id) for x in r.near] for r in whole.collect()}  # one row per pivot, k pairs each


def _blocks(counts: dict[int, int], pivots: np.ndarray, size: int) -> dict[int, list[int]]:
    """Cells of queries put into blocks of about `size` queries, neighbours together; a larger cell is dealt to several blocks."""
    left, out, block, room = sorted(counts), {}, 0, size
    at = left[0] if left else None
    while left:
        left.remove(at)
        parts = math.ceil(counts[at] / size)
        if parts > 1 or counts[at] > room:
            block, room = block + (room < size), size
        out[at] = list(range(block, block + parts))
        if parts > 1:
            block, room = block + parts, size
        else:
            room -= counts[at]
        if left:
            at = min(left, key=lambda c: float(np.linalg.norm(pivots[c] - pivots[at])))
    return out


def top_k(rows: DataFrame, is_query: F.Column, k: int = 10, vec: str = "embedding", vec_id: str = "vec_id",
          pivots: int = PIVOTS, block: int = QUERY_BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query with all rows but its own.

    Queries and rows go to their nearest pivot. From the cells' radii and smallest distances follows, for every block of queries, a distance
    within which k rows are certain; a row is sent to a block only if the triangle inequality lets it come that near. Blocks meet rows in
    slices of bounded size, whatever the cell, and each slice returns its k best per query.

    Vectors that are null or hold null or non-finite components, and rows without id, take no part. Shorter vectors are filled up with
    zeros. Ties go to the smaller id. Rows that share the query's id count as its own; queries that share an id are one query,
    with the greatest of their vectors. Empty tables give no rows. Scores outside a long are set to its nearest end.
    """
    spark = rows.sparkSession
    valid = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
                        ).where(finite("vec") & F.col("vec_id").isNotNull())
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(SCALE) * x.cast("double")).cast("double"), F.lit(2.0)))
    stats = valid.agg(F.max(F.size("vec")).alias("width"), F.max(F.sqrt(length)).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not stats.n:
        return empty
    width, norm = int(stats.width), float(stats.norm)
    cells = _pivots(valid, "vec", width, norm, pivots)
    data = stage_table(_place(valid, "vec", width, cells, False), "knn-rows")
    asks = valid.where("asks").groupBy("vec_id").agg(F.max("vec").alias("vec"))
    asked = stage_table(_place(asks, "vec", width, cells, True), "knn-queries")

    near = _least(data, k + 1)
    radius = {r.cell: (r.n, r.far) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).collect()}
    if not radius:
        return empty
    between = np.sqrt(np.maximum(0.0, ((cells.pivots[:, None] - cells.pivots[None]) ** 2).sum(2)))
    owners = _blocks({c: n for c, (n, _) in radius.items()}, cells.pivots, block)
    reach = np.full(len(cells.pivots), -1.0)
    for c, (_, far) in radius.items():
        certain: dict[int, float] = {}
        for bound, i in sorted((far + between[c, j] + d, i) for j, ds in near.items() for d, i in ds):
            certain.setdefault(i, bound)
        # k + 1 ids, as one of them may be the query's own, whatever number of rows it has.
        within = list(certain.values())[k] if len(certain) > k else math.inf
        reach[c] = (far + within) * (1 + 1e-9) + 1e-3

    asking, n_blocks = sorted(radius), max(b for bs in owners.values() for b in bs) + 1

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = b.column("cell").to_numpy(), b.column("dist").to_numpy()
            need = np.zeros((b.num_rows, n_blocks), bool)
            for c in asking:
                hit = np.abs(between[c][cell] - dist) <= reach[c]
                need[:, owners[c]] |= hit[:, None]
            at, to = np.nonzero(need)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), b.column("vec").take(pa.array(at)), pa.array(to.astype(np.int32))],
                                             names=["vec_id", "vec", "block"])

    kind = data.schema["vec"].dataType.simpleString()
    sent = data.mapInArrow(wanted, f"vec_id long, vec {kind}, block int")
    slices = max(1, math.ceil(stats.n / slice_rows))
    sent = sent.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit("slice")), F.lit(slices)).cast("int"))
    deal = F.create_map(*[x for c in asking for x in (F.lit(c), F.array(*map(F.lit, owners[c])))])[F.col("cell")]
    dealt = asked.withColumn("_to", deal).withColumn(
        "block", F.element_at("_to", (F.pmod(F.xxhash64("vec_id", F.lit("block")), F.size("_to")) + 1).cast("int"))).drop("_to")
    dealt = dealt.select("vec_id", "vec", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def solve(queries: pa.Table, found: pa.Table) -> pa.Table:
        ids = found.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, rows_ = ids[order], matrix(found.column("vec"), width)[order]
        asks, points = queries.column("vec_id").to_numpy(), matrix(queries.column("vec"), width)
        out: list[tuple] = []
        for lo in range(0, len(asks), 256):
            table_ = scores(points[lo:lo + 256], rows_)
            for q, line in zip(asks[lo:lo + 256], table_):
                # One place more than asked, as the query's own row may be among the best; more if its id repeats.
                mine = int(np.searchsorted(ids, q, "right") - np.searchsorted(ids, q, "left"))
                most = min(k + mine, len(line))
                if most < len(line) and line.dtype != object:
                    at = np.flatnonzero(line >= np.partition(line, len(line) - most)[len(line) - most])
                else:
                    at = np.arange(len(line))
                at = at[ids[at] != q]
                at = at[np.argsort(-line[at], kind="stable")][:k]
                out.extend((int(q), int(ids[i]), int(line[i])) for i in at)
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    best = dealt.groupBy("block", "slice").cogroup(sent.groupBy("block", "slice")).applyInArrow(
        solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, v as qv from e where vec_id % 100 = 0),
s as (
  select query_id, vec_id, list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2]))::bigint as score
  from q, e where vec_id <> query_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


@query("op1_voronoi_knn", ORACLE)
def op1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 100 == 0)
