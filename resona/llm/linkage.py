"""Links between texts with similar sets of word shingles: banded sketches, estimates, exact checks, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage_table
from .components import components
from .shingles import overlap, parts, shingle_hashes, shingle_set, shingle_sets, words

#: Up to so many ids (some 50 MB as rows) a semi or anti join sends them to all tasks; beyond it both sides are shuffled.
BROADCAST_IDS = 500_000
#: Members that meet their hub in one task.
HUB_ROWS = 2_000
#: Items, and shingles of all items, of a block whose pairs with another block are one task; minima by which it leaves out pairs.
BLOCK_ROWS, BLOCK_SHINGLES, MINIMA = 512, 2_000_000, 128
#: Of so many items all pairs are compared by their whole sets.
FEW = 12
#: Estimates this far below the threshold are not checked further: over five standard errors of the sketch.
MARGIN = 0.17

# SetSketch parameters: rate of the exponential values, base of the scale, largest register.
RATE, BASE, LARGEST = 20.0, 1.001, 65_534


def tune_bands(threshold: float, rows: int, recall: float) -> int:
    """Bands of so many rows that a pair at the threshold shares one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


@dataclass(frozen=True)
class Rule:
    """Texts are linked where den * shared shingles >= num * shingles of both together."""

    words: int = 5
    lower: bool = False
    num: int = 80
    den: int = 100
    rows: int = 5
    recall: float = 0.999999
    registers: bool = True

    @property
    def bands(self) -> int:
        return tune_bands(self.num / self.den, self.rows, self.recall)

    def shingles(self, text: str | None) -> np.ndarray:
        return shingle_set(text, self.words, self.lower)

    def shingles_of(self, tokens: list[bytes]) -> np.ndarray:
        """The same from words as they stand."""
        return np.unique(shingle_hashes(tokens, self.words))

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The shingles of each of many texts, some of which are hashed together."""
        for lo, hi in parts(texts):
            yield from shingle_sets([words(t, self.lower) for t in texts[lo:hi]], self.words)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = overlap(a, b)
        return shared > 0 and self.den * shared >= self.num * (len(a) + len(b) - shared)


@lru_cache(maxsize=8)
def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    draw = lambda: rng.integers(0, 2 ** 64, m, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def minima(shingles: np.ndarray, m: int) -> np.ndarray:
    """For each of m hash functions, the least value over the set. Minima of parts merge by minimum."""
    factor, offset = _seeds(m)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 512):
        part = shingles[lo:lo + 512, None] ^ offset
        part *= factor
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, part.min(0), out=least)
    return least


def registers(shingles: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers: the minimum of exponential values, cut to a whole number on a logarithmic scale.

    Registers of a union are the larger of those of its parts; two sets agree in a register with about their Jaccard similarity.
    """
    u = (minima(shingles, m) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54
    x = -np.log1p(-u) / RATE
    return np.clip(1 + np.floor(-np.log(x) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 200) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows of a and b) by the joint likelihood of their registers, given the set sizes.

    With the sizes' shares u and v, a register is larger in a with probability p(u - vJ) and in b with p(v - uJ),
    p(x) = -log_base(1 - x (base - 1) / base). The J in steps of 1 / steps with the highest likelihood is returned.
    """
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps + 1)[None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    pa_, pb_ = p(u - v * j), p(v - u * j)
    like = above[:, None] * np.log(pa_) + below[:, None] * np.log(pb_) + same[:, None] * np.log(np.clip(1 - pa_ - pb_, 1e-12, 1))
    like = np.where(j <= np.minimum(u / v, v / u) + 1e-9, like, -np.inf)
    return j[0][like.argmax(1)]


SKETCH = "n int, digest binary, keys array<long>, regs binary"


def sketch(shingles: np.ndarray, rule: Rule) -> tuple[int, bytes | None, list[int], bytes | None]:
    """Set size, digest of the set, band keys, registers. The empty set has no digest and no band."""
    n = len(shingles)
    if not n:
        return 0, None, [], None
    m = rule.bands * rule.rows
    regs = registers(shingles, m) if rule.registers else minima(shingles, m)
    width = rule.rows * regs.itemsize
    raw = regs.tobytes()
    keys = [xxhash.xxh3_64_intdigest(raw[i * width:(i + 1) * width], i) for i in range(rule.bands)]
    signed = [k - 2 ** 64 if k >= 2 ** 63 else k for k in keys]
    return n, xxhash.xxh3_128_digest(shingles.tobytes()), signed, raw if rule.registers else None


def sketch_all(sets: list[np.ndarray], rule: Rule) -> tuple[list[int], list[bytes | None], list[list[int]]]:
    """Set sizes, digests and band keys of many sets at once, the same as `sketch` gives for each under a rule without registers."""
    sizes = np.array([len(x) for x in sets], np.int64)
    digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
    at = np.flatnonzero(sizes)
    keys: list[list[int]] = [[] for _ in sets]
    if len(at):
        every = np.concatenate([sets[i] for i in at])
        starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
        factor, offset = _seeds(rule.bands * rule.rows)
        least = np.empty((len(at), len(factor)), np.uint64)
        for m in range(len(factor)):
            x = (every ^ offset[m]) * factor[m]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            least[:, m] = np.minimum.reduceat(x, starts)
        width, bands = rule.rows * least.itemsize, range(rule.bands)
        for i, raw in zip(at.tolist(), (r.tobytes() for r in least)):
            own = [xxhash.xxh3_64_intdigest(raw[k * width:(k + 1) * width], k) for k in bands]
            keys[i] = [k - 2 ** 64 if k >= 2 ** 63 else k for k in own]
    return sizes.tolist(), digests, keys


def sketches(items: DataFrame, rule: Rule) -> DataFrame:
    """items (id, text) -> id, n, digest, keys, regs."""
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(rule.shingles(t), rule) for t in b.column("text").to_pylist()]
            n, digest, keys, regs = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                names=["id", "n", "digest", "keys", "regs"])

    return items.select("id", "text").mapInArrow(run, f"id {kind}, {SKETCH}")


def with_ids(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """rows whose id is (left_semi) or is not (left_anti) among the distinct ids, without moving the rows if ids are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """pairs (x, hub) whose whole sets are similar enough.

    A hub's text is sent once per HUB_ROWS of its members, ahead of them, so a task holds one set and streams the others.
    Rows of texts that share an id are one item; any of its texts may make the link.
    """
    kind = pairs.schema["x"].dataType.simpleString()
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("salts"))
    members = pairs.join(hubs, "hub").select("x", "hub", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt"))
    ahead = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    left = texts.join(ahead, texts.id == ahead.hub).select("hub", "salt", F.lit(0).alias("role"), F.col("id").alias("x"), "text")
    right = texts.join(members, texts.id == members.x).select("hub", "salt", F.lit(1).alias("role"), "x", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        of = None
        for b in batches:
            hit = []
            every = rule.sets(b.column("text").to_pylist())
            for i, (group, role, own) in enumerate(zip(b.column("group").to_pylist(), b.column("role").to_pylist(), every)):
                if group != of:
                    sets, of = [], group
                if role == 0:
                    sets.append(own)
                elif any(rule.linked(own, s) for s in sets):
                    hit.append(i)
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("x").take(at), b.column("hub").take(at)], names=["a", "b"])

    dealt = left.unionAll(right).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "x")
    dealt = dealt.select(F.xxhash64("hub", "salt").alias("group"), "role", "x", "hub", "text")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _likely(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """pairs (x, hub) whose registers don't speak against a link."""
    if not rule.registers:
        return pairs
    floor = rule.num / rule.den - MARGIN

    @F.pandas_udf("double")
    def jaccard(a, b, na, nb):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype="float64")
        both = [np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b)]
        return pd.Series(np.concatenate([
            estimate(both[0][i:i + 1000], both[1][i:i + 1000], na.to_numpy(float)[i:i + 1000], nb.to_numpy(float)[i:i + 1000])
            for i in range(0, len(a), 1000)]))

    own = reps.select(F.col("id").alias("x"), F.col("n").alias("_n1"), F.col("regs").alias("_r1"))
    other = reps.select(F.col("id").alias("hub"), F.col("n").alias("_n2"), F.col("regs").alias("_r2"))
    return (pairs.join(own, "x").join(other, "hub").where(jaccard("_r1", "_r2", "_n1", "_n2") >= floor).select("x", "hub").distinct())


def _last_links(marked: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame | None:
    """Links (a, b) between components that still share a bucket; None where no bucket holds two of them.

    marked: key, id, n, comp, lead. Items that share such buckets, directly or over others, form a cluster. Its items are dealt
    to blocks of bounded size, and every pair of blocks is a task of its own that compares the items of different components by 128
    minima and then by their whole sets. Only links come out, no pairs.
    """
    kind = marked.schema["id"].dataType.simpleString()
    mixed = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rows = stage_table(marked.join(mixed.select("key"), "key", "left_semi").groupBy("id", "comp", "lead").agg(F.max("n").alias("n")), "link-mixed")
    if rows.isEmpty():
        return None
    clusters = components(rows, "id", "lead").withColumnRenamed("component", "cluster")
    members = stage_table(clusters.join(rows.groupBy("id", "comp").agg(F.max("n").alias("n")), "id"), "link-clusters")
    sizes = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "id", F.xxhash64("comp").alias("comp"), "block", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("k"))
    dealt = texts.join(placed, "id").repartition("cluster", "i", "k").sortWithinPartitions("cluster", "i", "k", "block", "id").select(
        F.xxhash64("cluster", "i", "k").alias("task"), "block", "id", "comp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task = None
        for b in batches:
            every = rule.sets(b.column("text").to_pylist())
            for t, *row in zip(*(b.column(c).to_pylist() for c in ("task", "block", "id", "comp")), every):
                if t != task and held:
                    yield compared(held)
                    held = []
                task = t
                held.append(tuple(row))
        if held:
            yield compared(held)

    def compared(held: list[tuple]) -> pa.RecordBatch:
        found = block_links([h[0] for h in held], [h[2] for h in held], [h[3] for h in held], rule)
        ends = [pa.array([held[x[side]][1] for x in found], type_) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    type_ = to_arrow_type(marked.schema["id"].dataType)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def block_links(blocks: list[int], comps: list[int], sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that join different components, between the items of two blocks (or inside one).

    A pair that agrees in too few of 128 minima to reach the threshold, by five standard errors, is not looked at further; likely ones come
    first, and components that are joined are not compared again. Of a few items all pairs are compared.
    """
    if len(sets) <= FEW:
        one = len(set(blocks)) == 1
        return _joining([(i, j) for i in range(len(sets)) for j in range(i) if one or blocks[i] != blocks[j]], comps, sets, rule)
    block, comp = np.array(blocks), np.array(comps)
    n = np.array([len(x) for x in sets], np.int64)
    least = np.stack([minima(x, MINIMA) for x in sets])
    t = rule.num / rule.den
    floor = MINIMA * (t - 5 * math.sqrt(t * (1 - t) / MINIMA))
    left = np.flatnonzero(block == block[0])
    right = np.flatnonzero(block != block[0])
    right = right if len(right) else left
    found: list[tuple[int, int, int]] = []
    for lo in range(0, len(left), 64):
        a = left[lo:lo + 64]
        same = np.zeros((len(a), len(right)), np.int16)
        for m in range(MINIMA):
            same += least[a, m][:, None] == least[right, m][None]
        likely = (same >= floor) & (comp[a][:, None] != comp[right][None]) & (a[:, None] != right[None])
        likely &= rule.den * np.minimum(n[a][:, None], n[right][None]) >= rule.num * np.maximum(n[a][:, None], n[right][None])
        i, j = np.nonzero(likely)
        found.extend(zip(same[i, j].tolist(), a[i].tolist(), right[j].tolist()))
    found.sort(key=lambda x: -x[0])
    return _joining([x[1:] for x in found], comps, sets, rule)


def _joining(pairs: list[tuple[int, int]], comps: list[int], sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Of these pairs of items the links that join components which are still different."""
    owner: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := owner.get(c, c)) != c:
            owner[c] = owner.get(up, up)
            c = up
        return c

    links = []
    for i, j in pairs:
        ri, rj = root(comps[i]), root(comps[j])
        if ri != rj and rule.linked(sets[i], sets[j]):
            owner[ri] = rj
            links.append((i, j))
    return links


def link(reps: DataFrame, texts: Callable[[DataFrame], DataFrame], rule: Rule) -> DataFrame | None:
    """id, component for linked items; None where no two share a band.

    reps (a stored table): id, n, keys, regs, one row per distinct set. texts(ids) gives id, text of some items.

    A band that several items share proposes links. First every item is compared with the least item of the bucket it shares
    most bands with, then with those of its other buckets, unless they are in one component by then. Buckets that still hold several components are
    left to _last_links, which examines all their pairs. Pairs inside one component are never looked at, so a group of near copies costs
    about one comparison a member.
    """
    members = reps.select("id", "n", F.explode("keys").alias("key"))
    leads = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("lead")).where("size > 1")
    crowd = stage_table(members.join(leads, "key"), "link-crowd")
    ids = stage_table(crowd.select("id").distinct(), "link-ids")
    if ids.isEmpty():
        return None
    known = stage_table(reps.join(ids, "id", "left_semi").select("id", "n", "regs"), "link-reps")
    picked = stage_table(texts(ids), "link-texts")

    def sizes(n1: str, n2: str) -> F.Column:
        return F.lit(rule.den) * F.least(n1, n2) >= F.lit(rule.num) * F.greatest(n1, n2)

    state: dict[str, DataFrame | None] = {"edges": None, "comps": None}

    def examine(pairs: DataFrame, name: str) -> None:
        add(stage_table(_verified(stage_table(_likely(pairs, known, rule), f"link-pairs-{name}"), picked, rule), f"link-edges-{name}"), name)

    def add(found: DataFrame, name: str) -> None:
        if not found.isEmpty():
            state["edges"] = found if state["edges"] is None else state["edges"].unionAll(found)
            state["comps"] = stage_table(components(state["edges"]), f"link-components-{name}")

    def label(rows: DataFrame, col: str, out: str) -> DataFrame:
        if state["comps"] is None:
            return rows.withColumn(out, F.col(col))
        comps = state["comps"].select(F.col("id").alias(col), F.col("component").alias("_c"))
        return rows.join(comps, col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")

    stars = crowd.where((F.col("id") != F.col("lead.id")) & sizes("n", "lead.n")).groupBy("id", F.col("lead.id").alias("hub")).agg(
        F.count(F.lit(1)).alias("shared"))
    stars = stage_table(stars.withColumnRenamed("id", "x"), "link-stars")
    # Of hubs that share equally many bands the smallest is taken.
    most = stars.groupBy("x").agg(F.max("shared").alias("shared"))
    first = stage_table(stars.join(most, ["x", "shared"]).groupBy("x").agg(F.min("hub").alias("hub")), "link-first")
    examine(first, "0")
    others = label(label(stars.join(first, ["x", "hub"], "left_anti").select("x", "hub"), "x", "cx"), "hub", "ch").where("cx <> ch")
    examine(others.select("x", "hub"), "1")
    marked = label(crowd.select("key", "id", "n", F.col("lead.id").alias("lead")), "id", "comp")
    more = _last_links(marked, picked, rule)
    if more is not None:
        add(stage_table(more, "link-edges-2"), "2")
    return state["comps"]
