"""Vector codes against Lloyd rounds that compare every part with every entry."""

import numpy as np
import pytest

from ontocat.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, trees string"


def plain(rows, entries=16, rounds=6):
    """Python integers throughout."""
    rows = sorted((r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = max([8, *(-(-len(r[1]) // 8) * 8 for r in rows)])
    most = V.limit(dims)
    held = [[max(-most, min(most, int(np.floor(np.float64(c) * 4096)) if abs(c) < 1e300 else most if c > 0 else -most)) for c in r[1]]
            + [0] * (dims - len(r[1])) for r in rows]
    width = dims // 8
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[list(part(v, p)) for v in held[:entries]] for p in range(8)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            own = [[] for _ in books[p]]
            for v in held:
                own[near(v, p)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(own, books[p])]
    out, of_label = [], {}
    for r, v in zip(rows, held):
        best = [near(v, p) for p in range(8)]
        error = sum(d for d, _ in best)
        of_label[r[2]] = of_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{i:02x}" for _, i in best), error, r[2]))
    sha = V.codebooks_digest([np.array(b, dtype=object) for b in books])
    return sorted(((i, code, error, min(of_label[label], (1 << 63) - 1), sha) for i, code, error, label in out), key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "kept", "kept") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, V.compressed(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("block", [7, 2048])
def test_equals_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(V, "TREE_ROWS", block)
    rng = np.random.default_rng(block)
    centers = rng.normal(size=(9, 16))
    rows = [(i, (centers[i % 9] + rng.normal(size=16) * rng.choice([1e-4, 0.3])).tolist(), [None, 1, 2][i % 3]) for i in range(200)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=8).tolist()
    rows = [(i, same, 1) for i in range(60)] + [(i, rng.normal(size=8).tolist(), None) for i in range(60, 90)]
    rows += [(None, same, 2), (5, same, 1), (200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1),
             (204, [], 3), (205, [1.0, 2.0, 3.0], 3), (206, [1e200] + [0.0] * 7, 4), (207, [-1e308] * 8, 4), (208, [30_000.0] * 11, 4)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[60:64]) == plain(rows[60:64])  # fewer rows than entries
    assert found(spark, [(1, None, 1)]) == [] and found(spark, []) == []


def test_cover_tree_holds_every_point_within_its_radius():
    rng = np.random.default_rng(4)
    points = np.unique(np.r_[rng.integers(-50, 50, (300, 4)), rng.integers(-3, 3, (60, 4))], axis=0)
    tree = V.cover_tree(points)
    assert sorted(tree["members"]) == list(range(len(points)))
    for at in range(len(tree["centers"])):
        own = points[tree["members"][tree["starts"][at]:tree["stops"][at]]]
        far = np.sqrt(((own - points[tree["centers"][at]]) ** 2).sum(axis=1)).max()
        assert far == pytest.approx(tree["radii"][at])
        a, z = tree["kids"][at]
        if a < z:
            assert tree["starts"][a] == tree["starts"][at] and tree["stops"][z - 1] == tree["stops"][at]
            assert (tree["starts"][a + 1:z] == tree["stops"][a:z - 1]).all()


def test_clustered_points_are_assigned_as_whole_subtrees():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (16, 8))
    points = np.unique(np.repeat(centers, 60, axis=0) + rng.integers(-20, 20, (960, 8)), axis=0)
    (nodes, _), (places, _) = V.assign(points, V.cover_tree(points), centers)
    assert len(places) == 0 and len(nodes) < 100
