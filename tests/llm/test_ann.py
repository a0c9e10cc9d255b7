import numpy as np
import pytest

from ontocat.llm import ann as A

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def test_hadamard_is_orthogonal():
    x = np.eye(16)
    assert np.allclose(A.hadamard(x) @ A.hadamard(x).T, np.eye(16)) and np.allclose(A.hadamard(A.hadamard(x)), x)


def test_nearest_axis_is_the_largest_coordinate():
    x = np.random.default_rng(1).normal(size=(50, 8))
    first = A.axes(x, 3)
    for row, best in zip(x, first):
        signed = np.stack([row, -row], 1).ravel()
        assert list(signed[best]) == sorted(signed, reverse=True)[:3]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    found = A.search(vectors)
    assert A.recall(found, vectors) >= 0.9
    assert found.groupBy("query_id").count().filter("count != 10").count() == 0


def test_scores_ranks_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6)).astype(np.float32)
    rows = [(i, base[i % 40].tolist(), 0) for i in range(300)]
    found = A.search(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for query, group in found.groupby("query_id"):
        group = group.sort_values("rank")
        assert list(group["rank"]) == list(range(1, 11))
        want = sorted((float(np.sqrt(((base[i % 40].astype(float) - base[query % 40]) ** 2).sum())), i) for i in range(300) if i != query)
        assert list(group.vec_id)[:6] == [i for _, i in want[:6]]  # the copies, in order of their ids
        assert all(s == pytest.approx(float(np.sqrt(((base[v % 40].astype(float) - base[query % 40]) ** 2).sum()))) for v, s in zip(group.vec_id, group.score))


def test_hot_bucket_is_dealt_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0, 0.0, 0.0, float(i % 2)], 0) for i in range(500)], SCHEMA)
    whole = sorted(map(tuple, A.search(rows).collect()))
    monkeypatch.setattr(A, "CHUNK_ROWS", 37)
    monkeypatch.setattr(A, "CHUNK_QUERIES", 2)
    assert sorted(map(tuple, A.search(rows).collect())) == whole


def test_small_and_unusable(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0), (100, [3.0, 0.0], 0), (5, None, 0), (6, [0.0, 0.0], 0),
            (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (None, [1.0, 1.0], 0),
            (200, None, 0), (1, [0.0, 1.0], 0), (11, [1.0, 0.0, 0.0], 0)]
    found = A.search(spark.createDataFrame(rows, SCHEMA)).toPandas().sort_values(["query_id", "rank"])
    assert list(map(tuple, found[["query_id", "vec_id"]].to_numpy())) == [(0, 1), (0, 2), (0, 100), (100, 0), (100, 1), (100, 2)]
    assert A.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert A.search(spark.createDataFrame([(100, [1.0], 0)], SCHEMA)).count() == 0


@pytest.mark.parametrize("times", [3, 20])
def test_repeated_rows_change_nothing(spark, times):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=6).tolist(), 0) for i in range(200)], SCHEMA)
    whole = sorted(map(tuple, A.search(rows).collect()))
    assert len(whole) == 20
    repeated = rows.crossJoin(spark.range(times)).select(*rows.columns)
    assert sorted(map(tuple, A.search(repeated).collect())) == whole


@pytest.mark.parametrize("times", [3, 20])
def test_an_id_with_many_vectors_is_one_candidate(spark, monkeypatch, times):
    monkeypatch.setattr(A, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(40)]
    rows += [(i, [x + 1e-3 * n for x in v], 0) for i, v, _ in rows[1:] for n in range(1, times)]
    found = A.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).toPandas().sort_values("rank")
    gaps = {}
    for i, v, _ in rows[1:]:
        gap = float(np.sqrt(((np.array(v) - rows[0][1]) ** 2).sum()))
        if i:
            gaps[i] = min(gap, gaps.get(i, gap))
    want = sorted((g, i) for i, g in gaps.items())[:10]
    got = found[found.query_id == 0]
    assert list(got["rank"]) == list(range(1, 11)) and list(got.vec_id) == [i for _, i in want]
    assert list(got.score) == pytest.approx([g for g, _ in want])


def test_nearest_counts_ids_not_rows():
    ids = np.array([1] * 10 + [2, 3])
    rows = np.array([[1.0 + n / 100, 0.0] for n in range(10)] + [[2.0, 0.0], [3.0, 0.0]])
    assert [v for _, v, _ in A.nearest(np.zeros((1, 2)), np.array([9]), rows, ids, 2)] == [1, 2]


def test_very_large_and_very_small_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e190]), (2, [-1e200, 3e200]), (3, [1.0, 2.0]), (4, [2.0, 2.0]), (100, [3e-200, 4e-200]), (5, [3e-200, 4.5e-200]),
            (6, [1e308, 0.0]), (200, [-1e308, 0.0])]
    found = A.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas().sort_values(["query_id", "rank"])
    by = {q: list(zip(g.vec_id, g.score)) for q, g in found.groupby("query_id")}
    assert {q: len(v) for q, v in by.items()} == {0: 8, 100: 8, 200: 8}
    assert by[0][0] == (1, 1e190) and by[0][1][0] == 3 and by[100][0] == (5, pytest.approx(0.5e-200, rel=1e-12))
    assert by[200][-1] == (6, float("inf"))


def test_distances_are_those_of_the_plain_formula():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(200, 64)), rng.normal(size=64)
    gaps = x - q
    assert (A.distances(x, q) == np.sqrt((gaps * gaps).sum(axis=1))).all()
