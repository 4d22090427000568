"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query, table
from .shingles import words

#: The model is fitted on at most so many labelled documents: those with the smallest hash of their id.
SAMPLE = 8_000
#: Features of fewer sample documents are left out; the L1 penalty is this over the root of the sample's size; most steps of the fit.
MIN_DOCS, PENALTY, STEPS = 4, 0.02, 100
GRADES = 3
#: Values of the sample that are looked up at once.
CELLS = 1 << 18
_ODD_ENDS = frozenset(b"!$#%&*@^~<>=+")
_EDGE = b".,;:!?\"'()[]"


def features(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of what a text shows: its words (A-Z lower-cased, without marks at the ends), their first four bytes, and
    bands of its shape.

    The shape is how many words repeat the word before, are upper case, are a mark alone or end with an unusual one, how many are distinct,
    and how long text and words are. A text without words has the band of length 0 only.
    """
    own = words(text)
    n = len(own)
    distinct = set(own)
    plain = {w.strip(_EDGE).lower() for w in distinct}
    out = [xxhash.xxh3_64_intdigest(w, 1) for w in plain if w]
    out.extend(xxhash.xxh3_64_intdigest(w, 3) for w in {w[:4] for w in plain})
    shape = [f"length:{n.bit_length()}"]
    if n:
        shares = {
            "again": sum(map(eq, own, own[1:])), "upper": sum(w.isupper() for w in own), "mark": sum(w[-1] in _ODD_ENDS for w in own),
            "bare": sum(len(w) < 3 and not w.isalnum() and w.isascii() for w in own)}
        shape += [f"{k}:{min(9, 10 * v // n) if v else -1}" for k, v in shares.items()]
        shape.append(f"word:{min(24, sum(map(len, own)) // n)}")
        if n >= 20:
            shape.append(f"distinct:{10 * len(distinct) // n}:{n.bit_length()}")
    out.extend(xxhash.xxh3_64_intdigest(s.encode(), 2) for s in shape)
    return np.unique(np.array(out, np.uint64))


@dataclass
class Ordinal:
    """P(grade > j) = 1 / (1 + exp(thresholds[j] - score)): one score, ordered thresholds. keys: sorted feature hashes."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        if not len(self.keys) or not len(found):
            return 0.0
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        return float(self.weights[at[self.keys[at] == found]].sum())

    def tails(self, score: float) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _frequent(flat: np.ndarray, times: int) -> np.ndarray:
    """Sorted distinct values that occur so many times at least."""
    ordered, gap = np.sort(flat), max(times, 1) - 1
    return np.unique(ordered[gap:][ordered[gap:] == ordered[:max(0, len(ordered) - gap)]])


def _cells(flat: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column (place among the sorted keys) of every value that is one of the keys; rows have so many values. Looked up in parts of bounded size."""
    ends = np.cumsum(sizes)
    rows, columns = [], []
    for lo in range(0, len(flat) if len(keys) else 0, CELLS):
        part = flat[lo:lo + CELLS]
        at = np.searchsorted(keys, part)
        at[at == len(keys)] = 0
        use = np.flatnonzero(keys[at] == part)
        columns.append(at[use].astype(np.int32))
        rows.append(np.searchsorted(ends, use + lo, "right").astype(np.int32))
    none = np.empty(0, np.int32)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def fit(sample: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, min_docs: int = MIN_DOCS, penalty: float = PENALTY,
        steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with an L1 penalty on the weights, by accelerated proximal steps.

    Thresholds start at the grades' shares and stay in order. No document, or one grade only, gives no weight.
    """
    y = np.asarray(grades, np.int64)
    if not len(y):
        return Ordinal(np.empty(0, np.uint64), np.empty(0), np.zeros(n_grades - 1))
    share = np.array([((y > j).sum() + 0.5) / (len(y) + 1.0) for j in range(n_grades - 1)])
    theta = np.log(1 - share) - np.log(share)
    flat = np.concatenate(sample) if sample else np.empty(0, np.uint64)
    keys = _frequent(flat, min_docs)
    row, column = _cells(flat, np.array([len(s) for s in sample], np.int64), keys)
    del flat
    width, penalty = len(keys), penalty / len(y) ** 0.5
    if not width or len(np.unique(y)) < 2:
        return Ordinal(keys, np.zeros(width), theta)

    low, high = np.full(len(y), np.inf), np.full(len(y), -np.inf)

    def loss(w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = np.bincount(row, w[column], len(y))
        low[:], high[:] = np.inf, -np.inf
        low[y > 0] = s[y > 0] - t[y[y > 0] - 1]
        high[y < n_grades - 1] = s[y < n_grades - 1] - t[y[y < n_grades - 1]]
        a, b = _sigmoid(low), _sigmoid(high)
        p = np.maximum(a - b, 1e-12)
        slope = (a + b - 1) / len(y)
        dt = np.zeros(n_grades - 1)
        np.add.at(dt, y[y > 0] - 1, (a * (1 - a) / p)[y > 0] / len(y))
        np.add.at(dt, y[y < n_grades - 1], -(b * (1 - b) / p)[y < n_grades - 1] / len(y))
        return float(-np.log(p).mean()), np.bincount(column, slope[row], width), dt

    w, t, step = np.zeros(width), theta, 1.0
    vw, vt, pace = w, t, 1.0
    for _ in range(steps):
        now, gw, gt = loss(vw, vt)
        while True:
            nw = vw - step * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
            nt = np.maximum.accumulate(vt - step * gt)
            dw, dt = nw - vw, nt - vt
            then, _, _ = loss(nw, nt)
            if then <= now + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        vw, vt = nw + (pace - 1) / faster * (nw - w), np.maximum.accumulate(nt + (pace - 1) / faster * (nt - t))
        w, t, pace, step = nw, nt, faster, step * 1.1
    kept = w != 0
    return Ordinal(keys[kept], w[kept], t)


def grade(quality: Column, toxic: Column) -> Column:
    """Rating from 0 to 2: toxic, poor, good. Null without a quality label."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2).cast("int")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Ordinal:
    """Fit on a bounded sample of docs (doc_id, text) with labels (doc_id, grade); null grades and ids are left out.

    The sample is joined to the texts as a list of at most limit ids, and one task fits it; the driver gets the weights.
    Of several grades for one document the lowest counts.
    """
    chosen = labels.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(
        F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(limit)
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(found, pa.binary())], names=["doc_id", "grade", "found"])

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("found", "ascending")])
        # Views of Arrow's own memory, no copies.
        sample, grades = [np.frombuffer(x.as_buffer() or b"", np.uint64) for x in rows.column("found")], rows.column("grade").to_numpy()
        del rows
        model = fit(sample, grades)
        return pa.table({"keys": [model.keys.tobytes()], "weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    sample = rated.mapInArrow(shown, "doc_id long, grade int, found binary")
    got = sample.groupBy().applyInArrow(fitted, "keys binary, weights binary, thresholds binary").first()
    if got is None:
        return fit([], np.empty(0))
    return Ordinal(np.frombuffer(got["keys"], np.uint64), np.frombuffer(got["weights"]), np.frombuffer(got["thresholds"]))


def graded(docs: DataFrame, model: Ordinal, name: str, text: str = "text") -> DataFrame:
    """docs with, under name, a struct of score, expected grade, and the probabilities of grade 1 or more and of grade 2 or more.

    Null and empty texts are graded by their length band alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most as many weights as the bounded sample has features
    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("score", "expected_grade", "p_fair", "p_good")])

    @F.pandas_udf(kind)
    def rate(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        found = np.array([m.score(features(t)) for t in texts])
        tails = np.array([m.tails(s) for s in found]).reshape(len(found), -1)
        return pd.DataFrame({"score": found, "expected_grade": tails.sum(1), "p_fair": tails[:, 0], "p_good": tails[:, 1]})

    return docs.withColumn(name, rate(F.col(text)))


def accepted(name: str, at_least: float = 0.5) -> Column:
    """Selection by tail probability: the document is more likely good than not."""
    return F.col(f"{name}.p_good") >= at_least


@query("op10_ordinal_quality")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return graded(docs, train(docs, labels), "rating").select("doc_id", "rating.*", accepted("rating").alias("accepted"))
