"""The fit of the quality classifier holds few copies of its sample."""

import tracemalloc

import numpy as np

from resona.llm import quality


def _sample(rng, rows, often, rare):
    return [np.unique(np.concatenate([rng.integers(0, 400, often), rng.integers(1 << 40, 1 << 60, rare)])).astype(np.uint64) for _ in range(rows)]


def test_cells_equal_the_inverse_of_the_distinct_values(monkeypatch):
    monkeypatch.setattr(quality, "CELLS", 7)
    sample = [*_sample(np.random.default_rng(2), 40, 30, 3), np.empty(0, np.uint64), np.array([5], np.uint64)]
    flat = np.concatenate(sample)
    values, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    use = (seen >= 4)[inverse]
    rows = np.repeat(np.arange(len(sample)), [len(x) for x in sample])[use]
    assert all(quality._frequent(flat, n).tolist() == values[seen >= n].tolist() for n in (0, 1, 2, 4, 30, 10_000))
    row, column = quality._cells(flat, np.array([len(x) for x in sample]), values[seen >= 4])
    assert row.tolist() == rows.tolist() and column.tolist() == (np.cumsum(seen >= 4) - 1)[inverse[use]].tolist()
    assert all(x.size == 0 for x in quality._cells(flat, np.array([len(x) for x in sample]), np.empty(0, np.uint64)))


def test_fit_needs_a_small_multiple_of_its_sample():
    rng = np.random.default_rng(3)
    sample = _sample(rng, 1000, 50, 1500)
    grades = rng.integers(0, 3, len(sample))
    size = sum(x.nbytes for x in sample)
    tracemalloc.start()
    model = quality.fit(sample, grades, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.thresholds) == 2 and peak < 4 * size, peak / size
