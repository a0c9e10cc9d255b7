"""Turtle export: grouped statements, files that stand alone, and the round trip through the import."""

import random

from conftest import make_graph
from ontocat.model import TRIPLE_COLUMNS
from ontocat.sources import turtle, turtle_export

U = "http://example.com/ontology/"


def back(spark, path):
    triples, rejects = turtle.parse_turtle(turtle.read_turtle(spark, path), "b", parts=True)
    return {tuple(r).__repr__().replace("_:b_", "_:") for r in triples.collect()}, rejects.count()


def test_statements_are_grouped(spark):
    g = make_graph(spark, [
        (U + "A", "rdfs:label", "one", "lit"), (U + "A", "rdfs:label", 'tw"o\n', "lit", None, "en"), (U + "A", "rdf:type", "rdfs:Class"),
        (U + "A", "http://e/x.", "http://e/a b"), ("_:n", U + "p", "5", "lit", "xsd:integer"), ("_:n", U + "p", "_:m", "bnode")])
    lines = [r.value for r in turtle_export.turtle_lines(g.coalesce(1)).collect()]
    assert [line for line in lines if not line.startswith("@")] == [
        "_:n user:p \"5\"^^xsd:integer ,", "        _:m .",
        "user:A a rdfs:Class ;", "    <http://e/x.> <http://e/a\\u0020b> ;", '    rdfs:label "one" ,', '        "tw\\"o\\n"@en .']
    assert "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ." in lines
    assert turtle_export.turtle_lines(g.limit(0)).count() == 0


def test_round_trip_is_the_identity(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turtle_export, "STATEMENT_ROWS", 7)
    rng = random.Random(5)
    texts = ["", "a", "'", '"""', "x\\", "\r\n.", "# no", "é\U0001f600 ;", "<http://e> .", "a . b"]
    iris = [U + "A", U + "b.c", U + "x/y", U + "-", "http://e/#", "urn:x:y", "rdf:nil", "http://e/%20{}", U + "é", U + "a:b", U]
    rows = []
    for _ in range(600):
        s, p = rng.choice(iris + ["_:n1", "_:n-2", "_:a.b"] + [iris[0]] * 20), rng.choice([i for i in iris if i != U] + ["rdf:type", "rdfs:label"])
        kind = rng.choice(["iri", "bnode", "lit", "typed", "lang"])
        if kind == "iri":
            rows.append((s, p, rng.choice(iris)))
        elif kind == "bnode":
            rows.append((s, p, rng.choice(["_:n1", "_:n-2", "_:a.b"]), "bnode"))
        else:
            rows.append((s, p, rng.choice(texts) + rng.choice(texts), "lit", rng.choice(["xsd:date", U + "own", "urn:t"]) if kind == "typed" else None,
                         rng.choice(["en", "de-at"]) if kind == "lang" else None))
    g = make_graph(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = turtle_export.export_turtle(g, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.text(path).inputFiles()[1:]  # the nodes are shared by several files
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got, rejected = back(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rejected == 0
    assert got == {repr(tuple(r)) for r in g.select(*TRIPLE_COLUMNS).collect()}


def test_relative_iris_need_the_base(spark, tmp_path):
    g = make_graph(spark, [("t/1", "rdf:type", "uc:Table"), ("t/1", "uc:name", "n", "lit")])
    got, rejected = back(spark, turtle_export.export_turtle(g, str(tmp_path / "with"), base="http://e/data/"))
    assert rejected == 0 and all(r.startswith("('http://e/data/t/1'") for r in got) and len(got) == 2
    got, rejected = back(spark, turtle_export.export_turtle(g, str(tmp_path / "without")))
    assert (len(got), rejected) == (0, 1)


def test_terms_are_made_behind_the_shuffle(spark):
    g = make_graph(spark, [(U + "A", "rdfs:label", "one", "lit")])
    plan = turtle_export.turtle_lines(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan.split("RepartitionByExpression")[0] and "StartsWith" not in plan.split("RepartitionByExpression")[1]
