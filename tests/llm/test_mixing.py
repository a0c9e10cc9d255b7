import random
from itertools import product

import pytest

from ontocat.llm import mixing as M

from .helpers import empty_docs, messy_docs, values


def nearest(counts, budget):
    sums = {sum(s * k for s, k in zip(counts, ks)) for ks in product(*[range(n + 1) for n in counts.values()])}
    return min(abs(x - budget) for x in sums)


def test_fit_is_as_near_as_possible():
    rng = random.Random(4)
    for _ in range(150):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        total = sum(s * n for s, n in counts.items())
        budget = rng.random() * total
        take = M.fit_budget(counts, budget)
        assert all(0 < n <= counts[s] for s, n in take.items())
        base = {s: int(n * budget / total) for s, n in counts.items()}
        left = {s: counts[s] - base[s] for s in counts}
        done = sum(s * n for s, n in base.items())
        assert abs(sum(s * n for s, n in take.items()) - budget) == pytest.approx(nearest(left, budget - done))


def test_large_budget_is_met_exactly():
    rng = random.Random(5)
    counts = {s: rng.randrange(1, 300) for s in rng.sample(range(1, 20_000), 2_000)}
    budget = sum(s * n for s, n in counts.items()) // 3
    assert sum(s * n for s, n in M.fit_budget(counts, budget).items()) == budget


def shares(sizes):
    """Targets by sharing and resharing until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return {**out, **{s: level * weight[s] for s in open_}}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix_documents(docs).select("doc_id", "source", "text", "mixed.*").toPandas()
    assert all(len(t.split()) >= 0 and s == len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t)) for t, s in zip(rows.text, rows["size"]))
    want = shares(rows.groupby("source")["size"].sum().to_dict())
    for source, group in rows.groupby("source"):
        assert group.target.iloc[0] == pytest.approx(want[source]) and group.target.nunique() == 1
        assert abs(group.taken.sum() - want[source]) <= 1 and (group.source_size == group["size"].sum()).all()
    assert (rows.taken <= 2 * rows["size"]).all()
    again = M.mix_documents(docs.repartition(5)).select("doc_id", "mixed.taken").toPandas()
    assert dict(zip(rows.doc_id, rows.taken)) == dict(zip(again.doc_id, again.taken))
    assert M.mixture(docs).count() == (rows.taken[rows["size"] > 0] / rows["size"][rows["size"] > 0]).sum()


def test_messy_and_empty(spark):
    docs = messy_docs(spark)
    rows = M.mix_documents(docs, out="m").select("doc_id", "source", "text", "m.*").collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == 0 == r.taken for r in rows if not (r.text or "").strip())
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert sum(r["size"] for r in mine) == mine[0].source_size and sum(r.taken for r in mine) <= 2 * mine[0].source_size
    assert M.mixture(docs).columns == docs.columns
    assert M.mix_documents(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert values(M.mix_documents(blank), "mixed.target", "mixed.taken") == [(0.0, 0), (0.0, 0)]
