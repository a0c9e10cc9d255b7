"""concept_summary of a batch too large to broadcast: hot subjects are one row of a task, and counts are joined once."""

from conftest import make_graph


def _graph(spark):
    rows = [("a", "rdf:type", "rdfs:Class"), ("a", "rdfs:label", "A", "lit"), ("a", "rdfs:subClassOf", "b"), ("a", "skos:broader", "b"),
            ("b", "rdf:type", "skos:Concept"), ("b", "rdfs:label", "B", "lit"), ("b", "rdfs:label", "B2", "lit"),
            ("x", "rdf:type", "rdf:Property"), ("x", "rdfs:domain", "a"), ("x", "rdfs:range", "a"), ("other", "skos:altLabel", "o", "lit"),
            *(("a", "skos:altLabel", f"alt {i}", "lit") for i in range(50)),
            *((f"t{i}", "uc:conceptAssignment", "b") for i in range(5)), ("t0", "uc:name", "n", "lit")]
    return make_graph(spark, rows)


def _large_batches(monkeypatch):
    from ontocat.operators import entities, joins

    monkeypatch.setattr(entities, "broadcast_if_bounded", lambda df: joins.broadcast_if_bounded(df, max_rows=-1))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_subjects_are_distinct_before_a_large_batch_meets_them(spark, monkeypatch):
    from ontocat.operators import entities as ent

    g = _graph(spark)
    _large_batches(monkeypatch)
    found = ent._subjects(g, ent.request_batch(ent.concept_members(g)))
    assert sorted(r.uri for r in found.collect()) == ["a", "b"]
    assert _plan(found).startswith("Join LeftSemi")  # was an Aggregate over the join of every triple


def test_counts_are_joined_once_and_right(spark, monkeypatch):
    from ontocat.operators import assignments as asg
    from ontocat.operators import entities as ent

    g = _graph(spark)
    want = [("a", "A", None, "http://www.w3.org/2000/01/rdf-schema#Class", 50, 4, 0, 2),  # two edges to a target with two labels
            ("b", "B", None, "http://www.w3.org/2004/02/skos/core#Concept", 0, 0, 10, 0)]
    assert sorted(map(tuple, asg.concept_summary(g, ent.concept_members(g)).collect())) == want
    _large_batches(monkeypatch)
    out = asg.concept_summary(g, ent.concept_members(g))
    assert sorted(map(tuple, out.collect())) == want
    detail = ent.concept_detail(g, ent.concept_members(g))
    names = {"n_relationships", "n_assigned_tables", "n_properties"}
    assert names < set(out.columns)
    top = [line for line in _plan(out).splitlines() if line.lstrip("+-: ").startswith("Join LeftOuter")]
    parts = sum(_plan(p).count("Join LeftOuter") for p in asg._summary_parts(g, ent.present_subjects(g, ent.concept_members(g))))
    assert len(top) - parts - _plan(detail).count("Join LeftOuter") == 1  # was 3
