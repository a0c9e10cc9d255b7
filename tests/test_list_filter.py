"""The list filter against the joined text of each item, with items that lie in many ranges."""

import random

import pytest

from conftest import make_graph
from ontocat.operators import search


@pytest.mark.parametrize("known", [1_000, 0])
def test_matches_across_fields_and_ranges(spark, monkeypatch, known):
    monkeypatch.setattr(search, "KNOWN_PIECES", known)
    rng = random.Random(2)
    labels = {"c/hot": sorted({"".join(rng.choice("abI ß") for _ in range(rng.randint(0, 3))) for _ in range(400)}),
              "c/two": ["x", "y"], "c/none": []}
    rows = [(c, "rdf:type", "rdfs:Class") for c in labels] + [("c/hot", "rdfs:label", "Hot", "lit"), ("c/two", "rdfs:label", "Two", "lit"),
            ("t/1", "rdf:type", "uc:Table"), ("t/1", "uc:name", "abba", "lit")]
    rows += [(c, "skos:altLabel", a, "lit") for c, own in labels.items() for a in own]
    joined = {(c, {"c/hot": "Hot", "c/two": "Two"}.get(c)): " ".join([*sorted(own), c, {"c/hot": "Hot", "c/two": "Two"}.get(c, "None")])
              for c, own in labels.items()}
    joined["t/1", "abba"] = "t/1 abba"
    hot = joined["c/hot", "Hot"]
    filters = {hot[i:i + n] for n in (1, 2, 5, 23) for i in range(0, len(hot) - n, 41)} | {"x y c/two two", "none", "zz", "", hot[-30:].lower()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = search.list_filter(make_graph(spark, rows), spark.createDataFrame([(q,) for q in filters], "q string"))
        got = sorted((r.q, r.uri) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((q, uri) for q in filters for (uri, _), text in joined.items() if q.upper() in text.upper())


def test_copies_are_enough(spark):
    rows = [("c/1", "rdf:type", t) for t in ("rdfs:Class", "skos:Concept")] + [("c/1", "rdfs:label", f"l{i}", "lit") for i in range(5)]
    g = make_graph(spark, rows + [("c/1", "skos:altLabel", "aa", "lit")])
    bag = search.ent.concepts_alt_labels(g, dedupe=False).collect()
    text = " ".join(["aa"] * max(r.n for r in bag))
    filters = ["aa aa", "aa aa aa", text, text + " aa", "aa c/1 l"]
    got = {r.q for r in search.list_filter(g, spark.createDataFrame([(q,) for q in filters], "q string")).collect()}
    assert got == {q for q in filters if any(q in f"{' '.join(['aa'] * r.n)} c/1 {r.label}" for r in bag)}
