"""Pairs of long texts of touching length buckets, compared in blocks of bounded size inside tasks.

Texts are dealt to cells: stretches of neighbouring buckets, or parts of a bucket that holds much. A block is a cell with itself, two parts of
one bucket, or two cells at the buckets where they touch; so every pair meets in one block, pairs form no rows, and a text is sent a few times
only, however many it is compared with.

In a block a pair is ruled out by bounds that no similar pair fails:
- characters in common, counted in classes;
- the first blocks that the matching takes. All common runs of `size` characters of all pairs are listed by one sort. As long as a run
  of that length is left between the blocks already taken, the matching takes the longest one (the first in the later text, then in the head), so
  the blocks are known, and what they leave above, below and beside them bounds the rest. Blocks of unlike texts lie far from the
  diagonal, and a few of them leave too little.
What is left is compared as before (functions/similarity.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.similarity import reaches
from ..session import bounded_batches, stage_table

#: Texts and characters of a cell; a block has up to four times as many.
CELL_TEXTS, CELL_CHARS = 2_500, 2_500_000
#: Rows of the cells' table that are sent to all tasks; a longer one is joined.
BROADCAST_CELLS = 200_000
#: Classes of characters that are counted, and rows of a result batch.
CLASSES, OUT_ROWS = 40, 50_000
#: Buckets whose runs are listed together, and texts from which on fewer are.
STRETCH, STRETCH_TEXTS = 8, 1_000
#: Lengths of runs that are tried; common runs looked at for each open pair, and at once.
SIZES, RUNS_EACH, RUNS_ONCE = (5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24), 24, 300_000
#: A run that occurs more than so many times for each text is not listed; pairs that both have such a run are not ruled out by runs.
COMMON_RUN = 8
#: Steps of the plain check of open pairs (their characters, and more for long texts) for each character of the block from which listing runs pays.
PAYS = 1
#: Common runs that are looked at in the time of one character of the plain check.
LISTS = 10
_UNIT = ["study_id", "lo", "lo_part", "hi", "hi_part"]
EDGES = "study_id string, p long, w long, p_bucket long, near boolean"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def needed(total: np.ndarray, ratio: float = vocab.NEAR_DUP_RATIO) -> np.ndarray:
    """similarity.needed_matches of many totals."""
    m = (ratio * total / 2).astype(np.int64)
    while (low := (m > 0) & (2.0 * (m - 1) / total >= ratio)).any():
        m -= low
    while (high := 2.0 * m / total < ratio).any():
        m += high
    return m


class Block:
    """The texts of a block, sorted by bucket and number, the pairs of them that are still open, and those that are similar for sure.

    side: 0 and 1 meet each other only, 2 all. A row of `pairs`, `open` and `sure` is the later text, a column the head.
    """

    def __init__(self, texts: list[str], seq: np.ndarray, bucket: np.ndarray, side: np.ndarray, head: np.ndarray, later: np.ndarray):
        order = np.lexsort((seq, bucket))
        self.texts = [texts[i] for i in order]
        self.seq, self.bucket, self.side, self.head, self.later = (x[order] for x in (seq, bucket, side, head, later))
        self.n = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.owner = np.repeat(np.arange(len(order), dtype=np.int32), self.n)
        self.rows = np.flatnonzero(self.later)
        self.pairs = np.zeros((len(self.rows), len(order)), bool)
        self.open, self.sure = self.pairs.copy(), self.pairs.copy()
        self.hint = 0
        self._by_characters()

    def _counts(self) -> np.ndarray:
        """Characters by class and text; the commonest have a class of their own."""
        kinds, at, n = np.unique(self.codes, return_inverse=True, return_counts=True)
        place = np.empty(len(kinds), np.int64)
        place[np.argsort(-n, kind="stable")] = np.arange(len(kinds))
        of_kind = np.where(place < CLASSES - 8, place, CLASSES - 8 + place % 8)
        cells = of_kind[at.reshape(-1)] * len(self.n) + self.owner
        small = np.int16 if self.n.max(initial=0) < 16_000 else np.int32
        return np.bincount(cells, minlength=CLASSES * len(self.n)).reshape(CLASSES, -1).astype(small)

    def _by_characters(self) -> None:
        counts = self._counts()
        edges = np.searchsorted(self.bucket, [self.bucket - 1, self.bucket + 2])
        for r, w in enumerate(self.rows):
            lo, hi = edges[0, w], edges[1, w]
            meet = self.head[lo:hi] & (self.seq[lo:hi] < self.seq[w])
            if self.side[w] != 2:
                meet &= self.side[lo:hi] != self.side[w]
            if not meet.any():
                continue
            apart = np.abs(counts[:, lo:hi] - counts[:, w:w + 1]).sum(0, dtype=counts.dtype)
            total = self.n[lo:hi] + self.n[w]
            self.pairs[r, lo:hi] = meet
            self.open[r, lo:hi] = meet & (apart <= total - 2 * needed(total))

    def drop_heads(self, gone: np.ndarray) -> None:
        self.head = self.head & ~gone
        self.open[:, gone] = False

    def rule_out_by_runs(self) -> None:
        """Close pairs by their first blocks, for stretches of a few buckets with their neighbours."""
        at = 0
        of_row = self.bucket[self.rows]
        while at < len(self.rows):
            first = of_row[at]
            c0 = int(np.searchsorted(self.bucket, first - 1))
            full = self.bucket[min(c0 + STRETCH_TEXTS, len(self.bucket) - 1)]
            last = max(first, min(first + STRETCH - 1, full - 2))
            c1, to = int(np.searchsorted(self.bucket, last + 2)), int(np.searchsorted(of_row, last + 1))
            if self.open[at:to, c0:c1].any():
                _Runs(self, c0, c1, at, to).rule_out()
            at = to


class _Runs:
    """The common runs of the rows r0 to r1 of a block with earlier texts of its columns c0 to c1; texts are in the order of their numbers."""

    def __init__(self, block: Block, c0: int, c1: int, r0: int, r1: int):
        self.block, self.r0, self.r1 = block, r0, r1
        self.columns = c0 + np.argsort(block.seq[c0:c1], kind="stable")
        place = np.empty(c1 - c0, np.int64)
        place[self.columns - c0] = np.arange(c1 - c0)
        self.rows = place[block.rows[r0:r1] - c0]
        self.open, self.sure = block.open[r0:r1][:, self.columns], np.zeros((r1 - r0, c1 - c0), bool)
        self.head, self.n = block.head[self.columns], block.n[self.columns]
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.codes = np.concatenate([block.codes[block.off[c]:block.off[c + 1]] for c in self.columns])
        self.owner = np.repeat(np.arange(c1 - c0, dtype=np.int32), self.n)
        self.ends = np.repeat(self.off[1:].astype(np.uint64), self.n)

    def _hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        """(size, hashes of the runs of that size that start at each place), size by size."""
        codes = self.codes.astype(np.uint64) + np.uint64(1)
        h, size = np.zeros(len(codes), np.uint64), 0
        for want in SIZES[self.block.hint:]:
            if want > len(codes):
                return
            while size < want:
                h = h[:len(codes) - size] * _M1 + codes[size:]
                size += 1
            g = h ^ (h >> np.uint64(29))
            g *= _M2
            yield want, g ^ (g >> np.uint64(32))

    def rule_out(self) -> None:
        at = np.flatnonzero(self.open.any(1))
        n = self.n[self.rows[at]]
        weight = int(self.open[at].sum(1) @ (n + n * n // 4_000))
        if weight < PAYS * len(self.codes) or len(self.codes) >= 1 << 31:
            return
        is_later = np.zeros(len(self.n), bool)
        is_later[self.rows[at]] = True
        most = RUNS_EACH * int(self.open.sum()) + 2 * len(self.codes)
        tried = []
        for size, h in self._hashes():
            tried.append(self._listed(size, h, is_later))
            if tried[-1][-1] <= most:
                break
        if tried:
            self.block.hint = max(0, SIZES.index(size) - 1)
            self._first_blocks(*tried[-1][:-1])
            for t in tried[-2::-1]:
                if t[-1] > LISTS * int((self.open & ~self.sure).sum(1) @ self.n[self.rows]):
                    break
                self._first_blocks(*t[:-1])
        self.block.open[self.r0:self.r1, self.columns] = self.open
        self.block.sure[self.r0:self.r1, self.columns] = self.sure

    def _listed(self, size: int, h: np.ndarray, is_later: np.ndarray) -> tuple:
        """size, h; start and count: by place, where the earlier places of its run are listed in the next; marks of very common runs by text; how many there are."""
        low = np.uint64((1 << max(1, len(self.codes) - 1).bit_length()) - 1)
        at = np.arange(len(h), dtype=np.uint64)
        keys = ((h & ~low) | at)[at + np.uint64(size) <= self.ends[:len(h)]]
        keys.sort()
        place = (keys & low).astype(np.int32)
        keys &= ~low
        text = self.owner[place]
        new_run = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new_run[1:])
        # Of the places of a run, the earlier ones in other texts that may be heads: from the run's first to the text's first.
        heads = np.arange(len(keys), dtype=np.int32) if self.head.all() else np.cumsum(self.head[text], dtype=np.int32) - self.head[text]
        run_first = np.maximum.accumulate(np.where(new_run, heads, 0))
        new_text = new_run.copy()
        new_text[1:] |= text[1:] != text[:-1]
        earlier = np.maximum.accumulate(np.where(new_text, heads, 0)) - run_first
        if not is_later.all():
            earlier[~is_later[text]] = 0
        first = np.flatnonzero(new_run)
        times = np.diff(np.append(first, len(keys)))
        marks = np.zeros(len(self.n), np.uint64)
        if times.max(initial=0) > (most := max(1_000, COMMON_RUN * len(self.n))):
            often = np.flatnonzero(np.repeat(times > most, times))
            earlier[often] = 0
            np.bitwise_or.at(marks, text[often], np.uint64(1) << (h[place[often]] % np.uint64(64)))
        start, count = np.zeros(len(self.codes), np.int32), np.zeros(len(self.codes), np.int32)
        start[place], count[place] = run_first, earlier
        return size, h, start, count, place if self.head.all() else place[self.head[text]], marks, int(earlier.sum(dtype=np.int64))

    def _first_blocks(self, size: int, h: np.ndarray, start: np.ndarray, count: np.ndarray, places: np.ndarray, marks: np.ndarray) -> None:
        """Rule out by the blocks of `size` and more characters. start and count: by place, where its run's places in heads are listed in `places`."""
        known = self.open & ~self.sure
        if marks.any():
            known &= (marks[self.rows][:, None] & marks) == 0
        bits = int(self.n.max()).bit_length() + 1
        runs = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        cost = np.cumsum(runs[self.off[self.rows + 1]] - runs[self.off[self.rows]])
        at = 0
        while at < len(self.rows):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + RUNS_ONCE, "right")))
            r, p = np.nonzero(known[at:to])
            if len(r):
                keep, sure = self._tile(size, h, start, count, places, known[at:to], self.rows[at:to], r, p, bits)
                self.open[at + r[~keep], p[~keep]] = False
                self.sure[at + r[sure], p[sure]] = True
            at = to

    def _tile(self, size, h, start, count, places, known, rows, r, p, bits) -> tuple[np.ndarray, np.ndarray]:
        """first_blocks of the known pairs of some rows."""
        own = np.flatnonzero(known.any(1))
        spans = self.n[rows[own]]
        x = np.repeat(self.off[rows[own]] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        row = np.repeat(own, spans)
        some = count[x] > 0
        x, row = x[some], row[some]
        c = count[x]
        y = places[np.repeat(start[x] - (np.cumsum(c, dtype=np.int64) - c), c) + np.arange(c.sum(dtype=np.int64))]
        flat = np.repeat(row * len(self.n), c) + self.owner[y]
        inside = np.flatnonzero(known.reshape(-1)[flat])
        x, y, flat = np.repeat(x, c)[inside], y[inside], flat[inside]
        same = h[x] == h[y]
        if not same.all():
            x, y, flat = x[same], y[same], flat[same]
        q = (np.cumsum(known.reshape(-1)) - 1)[flat]
        i, j = x - self.off[self.owner[x]], y - self.off[self.owner[y]]
        q, d, i = _sorted(bits, q, i - j + (1 << (bits - 1)), i)
        j = i - d + (1 << (bits - 1))
        begins = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])) if len(q) else q
        length = np.diff(np.append(begins, len(q))) + size - 1
        return first_blocks(self.n[rows[r]], self.n[p], q[begins], i[begins], j[begins], length, size, bits)


def _sorted(bits: int, group: np.ndarray, *keys: np.ndarray) -> list[np.ndarray]:
    """group and keys, all keys below 1 << bits, in the order of group, then of the keys; as one number where that fits."""
    if int(group.max(initial=0)).bit_length() + bits * len(keys) > 62:
        order = np.lexsort((*keys[::-1], group))
        return [group[order], *(k[order] for k in keys)]
    packed = group.astype(np.int64)
    for k in keys:
        packed = (packed << bits) | k
    packed.sort()
    out = []
    for _ in keys:
        out.append(packed & ((1 << bits) - 1))
        packed = packed >> bits
    return [packed, *out[::-1]]


def first_blocks(a: np.ndarray, b: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may reach the ratio, and which do for sure, when their matching takes the blocks of `size` and more characters in turn.

    a and b: lengths of the later texts and of the heads; pair, i, j, n: all common runs that cannot be made longer, of `size` and more
    characters: of which pair, where in both texts, and how long; sorted by pair.
    """
    need = needed(a + b)
    most = np.minimum(a, b)
    keep, matched = most >= need, np.zeros(len(a), np.int64)
    used = np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)]
    part, of = np.cumsum(used) - 1, pair[used]
    a0, b0 = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    a1, b1 = a[of], b[of]
    top = (1 << bits) - 1
    while len(part):
        part, n, i, j = _sorted(bits, part, top - n, i, j)
        n = top - n
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bi, bj, bn = i[first], j[first], n[first]
        change = bn + np.minimum(bi - a0, bj - b0) + np.minimum(a1 - bi - bn, b1 - bj - bn) - np.minimum(a1 - a0, b1 - b0)
        most = most + np.bincount(of, weights=change, minlength=len(a)).astype(np.int64)
        matched += np.bincount(of, weights=bn, minlength=len(a)).astype(np.int64)
        keep, sure = most >= need, matched >= need
        bi, bj, bn = bi[part], bj[part], bn[part]
        going = (keep & ~sure)[of][part]
        left = np.minimum(n, np.minimum(bi - i, bj - j))
        skip = np.maximum(0, np.maximum(bi + bn - i, bj + bn - j))
        right = n - skip
        in_left, in_right = going & (left >= size), going & (right >= size)
        new = np.concatenate([2 * part[in_left], 2 * part[in_right] + 1])
        i, j, n = (np.concatenate([i[in_left], (i + skip)[in_right]]), np.concatenate([j[in_left], (j + skip)[in_right]]),
                   np.concatenate([left[in_left], right[in_right]]))
        fi, fj, fn = bi[first], bj[first], bn[first]
        edges = [np.stack(x, 1).reshape(-1) for x in ((a0, fi + fn), (fi, a1), (b0, fj + fn), (fj, b1))]
        held, part = np.unique(new, return_inverse=True)
        part = part.reshape(-1)
        a0, a1, b0, b1 = (x[held] for x in edges)
        of = np.repeat(of, 2)[held]
    return keep, matched >= need


# ---------- blocks ----------

def _sketches(block: Block, kinds: int = 4, size: int = 8) -> np.ndarray:
    """The least of the hashes of runs of a text, in some orders; near copies have most in common."""
    h = np.zeros(len(block.codes), np.uint64)
    padded = np.concatenate([block.codes.astype(np.uint64) + np.uint64(1), np.zeros(size, np.uint64)])
    for k in range(size):
        h = h * _M1 + padded[k:k + len(h)]
    h ^= h >> np.uint64(31)
    out = np.empty((kinds, len(block.n)), np.uint64)
    for k in range(kinds):
        g = h * np.uint64((int(_M2) + 2 * k * 0x632BE59BD9B4E019) % (1 << 64))
        out[k] = np.minimum.reduceat(g ^ (g >> np.uint64(32)), block.off[:-1])
    return out


def _copies_aside(block: Block) -> dict[int, int]:
    """Later text: an earlier head that it resembles, looked for among texts with an equal sketch only; such texts are no heads for others here.

    So a large group of near copies is compared with its first.
    """
    found, seen = {}, {}
    row = np.full(len(block.n), -1)
    row[block.rows] = np.arange(len(block.rows))
    sketches = _sketches(block)
    for t in np.argsort(block.seq, kind="stable").tolist():
        marks = [(k, int(sketches[k, t])) for k in range(len(sketches))]
        if row[t] >= 0:
            for p in sorted({seen[m] for m in marks if m in seen}, key=lambda p: block.seq[p]):
                if block.open[row[t], p] and reaches(block.texts[t], block.texts[p]):
                    found[t] = p
                    break
        if block.head[t] and t not in found:
            for m in marks:
                seen.setdefault(m, t)
    return found


def compare(block: Block, mode: str) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(heads, later text, whether similar) by place in the block.

    mode: 'every' pair, the 'similar' ones, or 'heads': a text that resembles a head is set aside and is no head for later ones; given are
    the pairs that set texts aside, and all similar pairs of the heads that were not.
    """
    aside = np.zeros(len(block.n), bool)
    known: dict[int, int] = {}
    if mode == "heads":
        known = _copies_aside(block)
        aside[list(known)] = True
        block.drop_heads(aside)
    block.rule_out_by_runs()
    for r in np.argsort(block.seq[block.rows], kind="stable"):
        w = int(block.rows[r])
        near = block.open[r].copy()
        if mode == "heads":
            near &= ~aside
        for p in np.flatnonzero(near & ~block.sure[r]).tolist():
            near[p] = known.get(w) == p or reaches(block.texts[w], block.texts[p])
        if w in known:
            near[known[w]] = True
        if mode == "heads":
            aside[w] |= near.any()
        out = np.flatnonzero(block.pairs[r] if mode == "every" else near)
        if len(out):
            yield out, w, near[out]


def _runner(mode: str):
    def rows(unit: tuple, part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(part)
        seq = t.column("post_seq").to_numpy()
        texts = t.column("text").to_pylist()
        # Rows that repeat a number and its text are one text of the block; each pair then has as many rows as the joins by number gave.
        at: dict[tuple, int] = {}
        number = np.array([at.setdefault((s, x), len(at)) for s, x in zip(seq.tolist(), texts)])
        first = np.unique(number, return_index=True)[1]
        times = np.bincount(number)
        flag = {c: t.column(c).to_numpy()[first] for c in ("bucket", "side", "head", "later")}
        block = Block([texts[i] for i in first], seq[first], flag["bucket"], flag["side"], flag["head"], flag["later"])
        times = times[np.lexsort((seq[first], flag["bucket"]))]
        held: list[tuple[np.ndarray, ...]] = []

        def batch() -> pa.RecordBatch:
            p, w, near = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(p), pa.string()), pa.array(block.seq[p], pa.int64()), pa.array(
                block.seq[w], pa.int64()), pa.array(block.bucket[p], pa.int64()), pa.array(near)], ["study_id", "p", "w", "p_bucket", "near"])

        size = 0
        for p, w, near in compare(block, mode):
            if mode != "heads":
                n = (times[p] * times[w]) ** 2
                p, near = np.repeat(p, n), np.repeat(near, n)
            held.append((p, np.full(len(p), w), near))
            size += len(p)
            if size >= OUT_ROWS:
                yield batch()
                size = 0
        if held:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, part = None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in _UNIT)))
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if hi == lo:
                    continue
                if part and keys[lo] != unit:
                    yield from rows(unit, part)
                    part = []
                unit = keys[lo]
                part.append(b.slice(lo, hi - lo))
        if part:
            yield from rows(unit, part)

    return run


def _cells(texts: DataFrame) -> DataFrame:
    """study_id, bucket, cell, parts, and the cells that touch it where they are not the same: prev, prev_parts, next, next_parts."""
    counts = texts.groupBy("study_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("chars"))
    weight = F.greatest(F.col("n") / CELL_TEXTS, F.col("chars") / CELL_CHARS)
    line = W.partitionBy("study_id").orderBy("bucket")
    before = F.coalesce(F.sum("weight").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    cells = counts.withColumn("weight", weight).withColumn("parts", F.ceil("weight").cast("int")).withColumn(
        "cell", F.floor(before) * 2 + (F.col("parts") > 1).cast("long"))
    for name, step in (("prev", -1), ("next", 1)):
        touches = (F.lag("bucket", -step).over(line) == F.col("bucket") + step) & (F.lag("cell", -step).over(line) != F.col("cell"))
        cells = cells.withColumn(name, F.when(touches, F.lag("cell", -step).over(line))).withColumn(
            f"{name}_parts", F.when(touches, F.lag("parts", -step).over(line)))
    return cells.select("study_id", "bucket", "cell", "parts", "prev", "prev_parts", "next", "next_parts")


def _dealt(texts: DataFrame, tasks: int) -> DataFrame:
    """The texts once for each of their blocks, sorted by block."""
    cells = stage_table(_cells(texts), "long-cells")
    small = cells.count() <= BROADCAST_CELLS
    own = F.pmod(F.xxhash64("post_seq"), F.col("parts")).cast("int")

    def block(lo, lo_part, hi, hi_part, side):
        return F.struct(lo.alias("lo"), lo_part.alias("lo_part"), hi.alias("hi"), hi_part.alias("hi_part"), side.cast("int").alias("side"))

    def each(n: str, make):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make))

    me, part = F.col("cell"), F.col("_part")
    blocks = F.concat(
        each("parts", lambda y: block(me, F.least(part, y), me, F.greatest(part, y), F.when(y == part, 2).when(part < y, 0).otherwise(1))),
        F.coalesce(each("next_parts", lambda y: block(me, part, F.col("next"), y, F.lit(0))), F.array()),
        F.coalesce(each("prev_parts", lambda y: block(F.col("prev"), y, me, part, F.lit(1))), F.array()))
    dealt = texts.join(F.broadcast(cells) if small else cells, ["study_id", "bucket"]).withColumn("_part", own).withColumn("_b", F.explode(blocks))
    return dealt.select("study_id", "_b.lo", "_b.lo_part", "_b.hi", "_b.hi_part", "_b.side", "post_seq", "bucket", "head", "later", "text").repartition(
        4 * tasks, *_UNIT).sortWithinPartitions(*_UNIT, "post_seq")


def long_pairs(texts: DataFrame, mode: str, tasks: int) -> DataFrame:
    """EDGES between texts of touching buckets, the earlier one first; modes as in compare().

    texts: study_id, post_seq, text, len, bucket, head (may be p), later (may be w). All lengths from 192 on, so that the length rule holds
    wherever buckets touch.
    """
    bounded_batches(texts.sparkSession)
    return _dealt(texts, tasks).mapInArrow(_runner(mode), EDGES)
