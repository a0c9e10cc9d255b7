"""Namespaces of any number: nested ones, conflicts, and the way back, against a plain search."""

import random

import pytest

from ontocat.operators import joins, namespaces as ns

SCHEMA = "prefix string, iri string"


@pytest.mark.parametrize("bounded", [True, False])
def test_longest_of_many(spark, monkeypatch, bounded):
    if not bounded:
        monkeypatch.setattr(ns, "broadcast_if_bounded", lambda df: joins.broadcast_if_bounded(df, max_rows=10))
    rng = random.Random(1)
    table = {f"p{i}": "http://e/" + "".join(rng.choice("ab/#") for _ in range(rng.randint(0, 9))) for i in range(3_000)}
    table["é"] = "http://é/\U0001f600/"
    iris = ["http://e/" + "".join(rng.choice("ab/#") for _ in range(rng.randint(0, 14))) for _ in range(2_000)] + ["http://é/\U0001f600/x", "urn:x", "", None]
    by_iri = {}
    for prefix, iri in table.items():
        by_iri[iri] = min(prefix, by_iri.get(iri, prefix))

    def brute(iri):
        best = max((n for n in by_iri if iri.startswith(n)), key=len, default=None) if iri is not None else None
        return best and f"{by_iri[best]}:{iri[len(best):]}"

    valid, conflicts = ns.bindings(spark.createDataFrame([*table.items()], SCHEMA))
    assert conflicts.count() == 0
    got = ns.compact_iris(spark.createDataFrame([(i, 1) for i in iris], "iri string, qname int"), valid)
    assert {(r.iri, r.qname) for r in got.collect()} - {(None, None)} == {(i, brute(i)) for i in iris if i is not None}
    back = ns.expand_curies(got.filter("qname is not null").selectExpr("iri AS own", "qname AS curie"), valid)
    assert back.count() == sum(brute(i) is not None for i in set(iris)) and back.filter("iri <> own or iri is null").count() == 0



def test_conflicts_and_odd_rows(spark):
    rows = [("a", "x/"), ("a", "x/"), ("b", "y/"), ("b", "z/"), (None, "n/"), ("e", ""), ("f", None), ("", "empty/"), ("A", "x/")]
    valid, conflicts = ns.bindings(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, valid.collect())) == [("", "empty/"), ("A", "x/"), ("a", "x/")]
    assert sorted(map(tuple, conflicts.collect())) == [("b", "y/"), ("b", "z/")]
    got = ns.compact_iris(spark.createDataFrame([("x/1",), ("y/1",), ("empty/",)], "iri string"), valid)
    assert {tuple(r) for r in got.collect()} == {("x/1", "A:1"), ("y/1", None), ("empty/", ":")}
    curies = spark.createDataFrame([("a:1:2",), (":t",), ("b:1",), ("none",), (None,), ("a:1:2",)], "curie string")
    assert sorted(((r.curie, r.iri) for r in ns.expand_curies(curies, valid).collect()), key=repr) == sorted(
        [("a:1:2", "x/1:2"), ("a:1:2", "x/1:2"), (":t", "empty/t"), ("b:1", None), ("none", None), (None, None)], key=repr)
    none = valid.limit(0)
    assert ns.compact_iris(spark.createDataFrame([("x/1",)], "iri string"), none).collect()[0].qname is None
