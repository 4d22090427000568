"""Bit-plane k-means against plain integer k-means."""

import math
from hashlib import sha256

import numpy as np
import pytest

from resona.llm import planes


def plain(rows, k=8, rounds=10):
    """rows: (vec_id, vector). The contract, step by step, in Python integers."""
    kept = [(i, [math.floor(x * 1024) if abs(x) < 2 ** 50 else int(x) * 1024 for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: sha256(f"3:{r[0]}".encode()).hexdigest())[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(centroids)):
            own = [kept[j][1] for j, (_, a, _) in enumerate(got) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    got, top = assign(), 2 ** 63 - 1
    per = {c: sum(min(d, top) for _, a, d in got if a == c) for c in range(len(centroids))}
    total = min(sum(per.values()), top)
    return sorted((i, a, min(d, top), min(per[a], top), total, sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for i, a, d in got)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, vec array<double>, planes string, norm int")
    return sorted(tuple(r) for r in planes.clusters(df).collect())


def some(n, scale=1.0, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, scale, 64)]) for i in range(n)]


def test_dots_of_planes_are_exact():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-2000, 2000, (50, 64)), rng.integers(-2000, 2000, (7, 64))
    assert (planes.dots(planes.pack(a, 12), planes.pack(b, 12)) == a @ b.T).all()
    assert (planes.norms(planes.pack(a, 12)) == (a * a).sum(1)).all()
    counts = planes.unpack_counts(planes.pack(a, 12))
    assert (np.array(planes.weights(12)) @ counts == a.sum(0)).all()


def test_equals_plain_clustering(spark):
    rows = some(300)
    assert run(spark, rows) == plain(rows)


def test_vectors_that_take_no_part(spark):
    good = some(40, seed=2)
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    assert run(spark, good + bad) == plain(good)


def test_ties_repeats_and_few_rows(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    assert run(spark, same) == plain(same)
    few = some(3)
    assert run(spark, few) == plain(few)
    half = some(60, seed=5)
    # Equal rows under different ids, and the same rows twice.
    rows = half + [(i + 1000, v) for i, v in half[:30]]
    assert run(spark, rows) == plain(rows)
    one = half[:30] * 2
    assert run(spark, one) == plain(one)


def test_empty_table_and_missing_ids(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    got = planes.clusters(spark.createDataFrame([(None, [0.25] * 64), (4, [0.75] * 64)], "vec_id long, vec array<double>")).collect()
    assert {(r.vec_id, r.distance) for r in got} == {(None, 0), (4, 0)}


@pytest.mark.parametrize("scale", [1e4, 1e30])
def test_large_components(spark, scale):
    rows = some(40, scale)
    assert run(spark, rows) == plain(rows)
