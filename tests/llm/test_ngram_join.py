import random

import numpy as np
import pytest

from ontocat.llm import common, ngram_join as N
from ontocat.operators import joins

from .helpers import empty_docs, messy_docs, sentence, words

DOCS = "doc_id bigint, text string"


def sets_of(texts, ngram):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i:i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} if w else set())
    return out


def brute(rows, ngram, part, whole):
    """Set sizes and smallest reachable ids by comparing every pair."""
    sets, links = sets_of([t for _, t in rows], ngram), N.Links()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and whole * len(a & sets[j]) >= part * len(a | sets[j]):
                links.add(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = links.find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return [(doc, len(sets[i]), least[links.find(i)]) for i, (doc, _) in enumerate(rows)]


def edited(rng, text, share):
    out = text.split()
    for at in range(len(out)):
        if rng.random() < share:
            out[at] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(out)


def near_rows(seed, n=120):
    rng = random.Random(seed)
    bases = [sentence(rng, rng.randrange(3, 150)) for _ in range(6)]
    rows = [(i, edited(rng, rng.choice(bases), rng.choice([0, 0.005, 0.01, 0.02, 0.05]))) for i in range(n)]
    common_part = sentence(rng, 60)
    return rows + [(1000 + i, common_part + " " + sentence(rng, 15)) for i in range(40)]


@pytest.mark.parametrize("ngram,part", [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, ngram, part, small):
    rows = near_rows(ngram)
    if small:  # also the ways beyond the bounds: parts of n-grams and groups, a filter and a shuffled join
        monkeypatch.setattr(N, "broadcast_if_bounded", lambda df: joins.broadcast_if_bounded(df, max_rows=-1))
    options = {"run_rows": 3, "group_rows": 4, "sketch_bits": 6, "long": 40} if small else {}
    found = N.similar_documents(spark.createDataFrame(rows, DOCS), ngram=ngram, similarity=(part, 100), **options)
    got = sorted((r.doc_id, r.n, r.component_id) for r in found.collect())
    assert got == sorted(brute(rows, ngram, part, 100))


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(500, 60, False)
        sets = list({tuple(sorted({int(x) for x in base if rng.random() > 0.06} | set(rng.choice(500, rng.integers(0, 6)).tolist()))) for _ in range(25)})
        arrays = [np.array(s, np.uint64) for s in sets if s]
        links, want = N.Links(), N.Links()
        for a, b in N.similar_links(arrays, (85, 100)):
            assert 100 * len(np.intersect1d(arrays[a], arrays[b])) >= 85 * len(np.union1d(arrays[a], arrays[b]))
            links.add(a, b)
        for a in range(len(arrays)):
            for b in range(a):
                if 100 * len(np.intersect1d(arrays[a], arrays[b])) >= 85 * len(np.union1d(arrays[a], arrays[b])):
                    want.add(a, b)
        assert all((links.find(a) == links.find(b)) == (want.find(a) == want.find(b)) for a in range(len(arrays)) for b in range(a))


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        for bits in (N.SHORT_BITS, N.LONG_BITS):
            assert np.bitwise_count(N.parity_bits(a, bits) ^ N.parity_bits(b, bits)).sum() <= len(np.setxor1d(a, b))


def test_messy_and_one_of_each(spark):
    docs = messy_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = N.similar_documents(docs)
    assert sorted(((r.doc_id, r.n, r.component_id) for r in found.collect()), key=repr) == sorted(brute(rows, 3, 90, 100), key=repr)
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {1, 4, 5, 6, 7, 8, 10, 11, 12} <= set(ids) and not {2, 3, 9} & set(ids) and ids.count(1) == 1
    assert N.similar_documents(empty_docs(spark)).count() == 0 and N.one_of_each(empty_docs(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(101, 100), (100, 102)] + [(200, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sorted_runs_keep_runs_whole():
    import pyarrow as pa
    values = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 13):
        batches = [pa.RecordBatch.from_pydict({"k": values[i:i + size]}) for i in range(0, len(values), size)]
        tables = [t["k"].to_pylist() for t in common.sorted_runs(batches, ["k"])]
        assert sum(tables, []) == values
        assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


@pytest.mark.parametrize("ngram,part", [(3, 90), (1, 50)])
@pytest.mark.parametrize("small", [False, True])
def test_links_and_pairs_equal_brute_force(spark, ngram, part, small):
    rows = near_rows(7, 60) + [(2000 + i, None) for i in range(2)]
    sets = sets_of([t for _, t in rows], ngram)
    similar = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])
               if a and b and 100 * len(a & b) >= part * len(a | b)]
    links = [sum(i in p for p in similar) for i in range(len(rows))]
    options = {"run_rows": 3, "group_rows": 4, "sketch_bits": 6, "long": 40} if small else {}
    docs = spark.createDataFrame(rows, DOCS)
    found = N.similar_documents(docs, ngram=ngram, similarity=(part, 100), links=True, **options)
    want = [(doc, n, least, links[i]) for i, (doc, n, least) in enumerate(brute(rows, ngram, part, 100))]
    assert sorted((r.doc_id, r.n, r.component_id, r.n_links) for r in found.collect()) == sorted(want)
    first = {frozenset(s): doc for (doc, _), s in reversed(list(zip(rows, sets)))}
    pairs = {tuple(sorted((first[frozenset(sets[i])], first[frozenset(sets[j])]))) for i, j in similar if sets[i] != sets[j]}
    forest = N.Links()
    for p in pairs:
        forest.add(*p)
    got = [(r.doc_id, r.other_id) for r in N.similar_pairs(docs, ngram=ngram, similarity=(part, 100), **options).collect()]
    assert len(pairs) > len(forest.links) and sorted(got) == sorted(pairs)  # links that close a cycle are there too


def test_a_run_of_copies_costs_its_rows_not_its_pairs(monkeypatch):
    import pyarrow as pa
    rng, rows, tried = np.random.default_rng(5), 3_000, []
    monkeypatch.setattr(N.Links, "add", lambda self, x, y, add=N.Links.add: (tried.append((x, y)), add(self, x, y)))
    keys = [int(i).to_bytes(4, "big") for i in rng.permutation(rows)]
    many = [np.zeros(N.LONG_BITS // 64, np.uint64).tobytes()] * rows
    batch = pa.RecordBatch.from_pydict({
        "key": pa.array(keys, pa.binary()), "token": [7] * rows, "pair": [0] * rows, "component": [b"c"] * rows, "n": pa.array([400] * rows, pa.int32()),
        "pos": pa.array([3] * rows, pa.int32()), "low": [5] * rows, "high": [9] * rows, "many": pa.array(many, pa.binary())})
    for step in (N._candidates, N._refined):
        tried.clear()
        links = [pair for out in step((80, 100))(iter([batch])) for pair in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert len({k for pair in links for k in pair}) == rows and len(links) == rows - 1 == len(tried)


@pytest.mark.parametrize("rows", [5, 31, 32, 70])
def test_walked_and_paired_runs_connect_the_same(monkeypatch, rows):
    import pyarrow as pa
    rng = np.random.default_rng(rows)
    for _ in range(20):
        n = np.sort(rng.integers(60, 90, rows))
        batch = pa.RecordBatch.from_pydict({
            "key": pa.array([bytes([i]) for i in range(rows)], pa.binary()), "token": [7] * rows, "pair": [0] * rows, "n": pa.array(n, pa.int32()),
            "pos": pa.array(rng.integers(0, 9, rows), pa.int32()), "low": rng.integers(0, 2 ** 9, rows), "high": rng.integers(0, 2 ** 9, rows)})
        found = []
        for limit in (2, 10 ** 6):
            monkeypatch.setattr(N, "WALKED_ROWS", limit)
            links = N.Links()
            for out in N._candidates((90, 100))(iter([batch])):
                for x, y in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                    links.add(x, y)
            found.append([[links.find(bytes([i])) == links.find(bytes([j])) for j in range(i)] for i in range(rows)])
        assert found[0] == found[1]
