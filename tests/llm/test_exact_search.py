"""Exact search against all integer inner products."""

import math

import numpy as np
import pytest

from ontocat.llm import exact_search as E

SCHEMA = "vec_id bigint, embedding array<double>, label int, h string, cells string, rank string"


def plain(rows, k=5, step=50):
    rows = [(i, [max(-E.LIMIT, min(E.LIMIT, math.floor(c * 256) if abs(c) < 1e300 else int(math.copysign(E.LIMIT, c)))) for c in v])
            for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in {i for i, _ in rows if i % step == 0}:
        best = {}
        for qi, qv in rows:
            if qi == q:
                for i, v in rows:
                    if i != q and len(v) == len(qv):
                        s = sum(a * b for a, b in zip(qv, v))
                        best[i] = max(best.get(i, s), s)
        for rank, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1):
            out.append((q, rank, i, max(-(2 ** 63) + 1, min(2 ** 63 - 1, -s))))
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, "kept", "kept", "kept") for i, v in rows], SCHEMA)
    return sorted(map(tuple, E.search(frame, **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_products(spark, monkeypatch, seed):
    monkeypatch.setattr(E, "LEAST_PART", 40)
    monkeypatch.setattr(E, "MOST_QUERIES", 3)
    monkeypatch.setattr(E, "FIT_ROWS", 100)
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 30])).tolist()) for i in range(700)]
    assert found(spark, rows) == plain(rows)


def test_copies_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    same, other = rng.normal(size=6).tolist(), rng.normal(size=6).tolist()
    rows = [(i, same) for i in range(400)] + [(i, other) for i in range(380, 420)] + [(i, rng.normal(size=6).tolist()) for i in range(400, 500)]
    rows += rows[:30] + [(50, other), (7, [9.0] * 6), (7, [-9.0] * 6)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, k=1) == plain(rows, k=1)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.0, 0.0]), (2, [1e200, -1e200]), (3, [1e308, 1e308]), (50, [-1e300, 3.0]), (100, [0.0, -0.0]), (4, None), (5, [None, 1.0]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (150, []), (8, []), (9, [1.0, 2.0, 3.0]), (200, None), (10, [1e-300, 1.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(50, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(size=(500, 8)) * 256), np.floor(rng.normal(size=(20, 8)) * 256)
    edges = E.borders(x[:100], E.CELLS)
    cells = E.quantise(x, edges)
    low, high = np.zeros((8, E.CELLS)), np.zeros((8, E.CELLS))
    for d in range(8):
        for c in set(cells[:, d]):
            low[d, c], high[d, c] = x[cells[:, d] == c, d].min(), x[cells[:, d] == c, d].max()
    lower, upper = E.bounds(q, cells, low, high)
    assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
