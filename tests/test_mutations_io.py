"""Algebraic checks of mutations and N-Triples import/export."""

from pyspark.sql import functions as F

from conftest import make_graph
from ontocat.model import TRIPLE_COLUMNS
from ontocat.operators import entities as ent
from ontocat.operators import graphview
from ontocat.operators import mutations as mut
from ontocat.operators import tagsync
from ontocat.sources import ntriples
from ontocat.sources.store import open_graph, snapshot

EX = "http://example.org/zoo/"


def rows(g):
    return sorted(tuple(r) for r in g.select(*TRIPLE_COLUMNS).collect())


def base(spark):
    return make_graph(spark, [
        (EX + "Dog", "rdf:type", "rdfs:Class"), (EX + "Dog", "rdfs:label", "Dog", "lit"),
        (EX + "Dog", "rdfs:comment", "barks", "lit"), (EX + "Dog", "skos:altLabel", "Hund", "lit"),
        (EX + "p", "rdf:type", "rdf:Property"), (EX + "p", "rdfs:comment", "old", "lit"),
        (EX + "t", "rdf:type", "uc:Table"), (EX + "t", "uc:name", "a.b.c", "lit"),
        (EX + "t", "uc:conceptAssignment", EX + "Dog"),
    ])


def test_inserts_are_idempotent(spark):
    g = base(spark)
    cmds = spark.createDataFrame([(1, EX + "t", EX + "Dog"), (2, EX + "t2", EX + "Dog")],
                                 "seq long, entity_uri string, target_uri string")
    once = mut.assign_concepts(g, cmds)
    twice = mut.assign_concepts(once, cmds)
    assert rows(once) == rows(twice)
    assert len(rows(once)) == len(rows(g)) + 1


def test_delete_after_add_restores(spark):
    g = base(spark)
    cmds = spark.createDataFrame([(1, EX + "Dog", "skos:broader", EX + "Animal")],
                                 "seq long, subject_uri string, predicate_type string, object_uri string")
    added, rejected = mut.add_relationships(g, cmds)
    assert rejected.count() == 0 and len(rows(added)) == len(rows(g)) + 1
    assert rows(mut.delete_relationships(added, cmds)) == rows(g)


def test_unknown_prefix_rejected(spark):
    cmds = spark.createDataFrame([(1, EX + "Dog", "nope:rel", EX + "Animal"), (2, EX + "Dog", "", EX + "A")],
                                 "seq long, subject_uri string, predicate_type string, object_uri string")
    g2, rejected = mut.add_relationships(base(spark), cmds)
    assert sorted(r.seq for r in rejected.collect()) == [1, 2]
    assert rows(g2) == rows(base(spark))


def test_first_registration_wins(spark):
    cmds = spark.createDataFrame([(1, EX + "t", "x.y.z"), (2, EX + "n", "first"), (3, EX + "n", "second"),
                                  (4, None, "m n")], "seq long, uri string, name string")
    g2 = mut.upsert_tables(base(spark), cmds)
    names = {r.s: r.o for r in g2.filter(F.col("p") == "uc:name").collect()}
    assert names[EX + "t"] == "a.b.c" and names[EX + "n"] == "first"
    assert names["http://example.com/ontology/m%20n"] == "m n"


def test_concept_comment_cannot_be_cleared_property_can(spark):
    g = base(spark)
    cu = spark.createDataFrame([(1, EX + "Dog", "Doggo", "", None)],
                               "seq long, uri string, label string, comment string, alt_labels array<string>")
    g1 = mut.update_concepts(g, cu)
    d = {(r.p, r.o) for r in g1.filter(F.col("s") == EX + "Dog").collect()}
    assert ("rdfs:comment", "barks") in d and ("rdfs:label", "Doggo") in d and ("skos:altLabel", "Hund") in d
    cu2 = spark.createDataFrame([(1, EX + "Dog", "Doggo", "", [])],
                                "seq long, uri string, label string, comment string, alt_labels array<string>")
    assert g.transform(lambda x: mut.update_concepts(x, cu2)).filter(F.col("p") == "skos:altLabel").count() == 0
    pu = spark.createDataFrame([(1, EX + "p", "P", "  ", None, None, None)],
                               "seq long, uri string, label string, comment string, domain string, range string, "
                               "alt_labels array<string>")
    g2 = mut.update_properties(g, pu)
    assert g2.filter((F.col("s") == EX + "p") & (F.col("p") == "rdfs:comment")).count() == 0


def test_delete_leaves_dangling_references(spark):
    g = base(spark)
    g2 = mut.delete_objects(g, spark.createDataFrame([(1, EX + "Dog")], "seq long, uri string"))
    assert g2.filter(F.col("s") == EX + "Dog").count() == 0
    assert g2.filter(F.col("o") == EX + "Dog").count() == 1
    assert tagsync.tag_mappings(g2).count() == 0


def test_export_import_round_trip(spark, graph_small):
    lines = ntriples.export_lines(graph_small)
    parsed, rejects = ntriples.parse_lines(lines)
    assert rejects.count() == 0
    assert parsed.subtract(graph_small.select(*TRIPLE_COLUMNS)).count() == 0
    assert graph_small.select(*TRIPLE_COLUMNS).subtract(parsed).count() == 0


def test_reimport_adds_blank_nodes_again(spark):
    lines = spark.createDataFrame([
        (f"<{EX}a> <http://www.w3.org/2000/01/rdf-schema#label> \"A\"@en .",),
        ("_:x <http://www.w3.org/2000/01/rdf-schema#label> \"B\" .",),
        ("not a statement",), ("# comment",), ("",)], "value string")
    g0 = base(spark)
    g1, added1, rej = ntriples.import_merge(g0, lines, "b1")
    assert added1.count() == 2 and rej.count() == 1
    g2, added2, _ = ntriples.import_merge(g1, lines, "b2")
    assert added2.count() == 1 and added2.first().s == "_:b2_x"


def test_snapshot_round_trip(spark, graph_small):
    snap = snapshot(spark, graph_small)
    assert rows(snap) == rows(graph_small)
    n_type = graph_small.filter(F.col("p") == "rdf:type").count()
    assert snap.filter(F.startswith("pk", F.lit("rdf:type"))).count() == n_type
    assert snap.filter(F.endswith("pk", F.lit("~lit"))).count() == graph_small.filter("o_kind = 'lit'").count()
    assert open_graph(spark, None).count() == 0


def test_iri_and_literal_escapes_round_trip(spark):
    from ontocat.sources.ntriples import escape, escape_iri, unescape, unescape_iri

    vals = ["ty/PROMO BURNISHED COPPER", 'a<b>c"d{e}f|g^h`i\\j', "x\\u0020y", "a\\u0020 b", "\\\\u005C z", "é 😀"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    out = df.select("x", unescape_iri(escape_iri(F.col("x"))).alias("i"), unescape(escape(F.col("x"))).alias("l"))
    assert all(r.x == r.i == r.l for r in out.collect())
    lines = ntriples.export_lines(make_graph(spark, [(EX + "a b", "rdfs:label", "x", "lit")]))
    assert lines.first().value.startswith(f"<{EX}a\\u0020b> ")


def test_long_literals_and_escapes_are_parsed(spark):
    long = "x" * 200_000 + "\\n" * 50_000
    cases = {"\\u00e9 x \\u00e9\\u0041": "é x éA", "a\\u0000b": "a\u0000b", "\\uD83D\\uDE00 \\U0001F600": "\U0001f600 \U0001f600",
             "\\\\u0041 \\\\n \\t\\\"": "\\u0041 \\n \t\"", "\\uD83D alone \\uDE00": "\ufffd alone \ufffd", "\\U00110000": "\ufffd",
             "\\u005Cn \\u005c\\u005C": "\\n \\\\", long: "x" * 200_000 + "\n" * 50_000}
    lines = [(f'<s{i}> <p> "{raw}" .',) for i, raw in enumerate(cases)]
    parsed, rejects = ntriples.parse_lines(spark.createDataFrame(lines, "value string"))
    assert rejects.count() == 0
    assert {r.s: r.o for r in parsed.collect()} == {f"s{i}": text for i, text in enumerate(cases.values())}


def test_one_term_form_for_every_incoming_iri(spark):
    thing = "http://www.w3.org/2002/07/owl#Thing"
    lines = spark.createDataFrame([(f"<{EX}a> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <{thing}> .",),
                                   (f"<{EX}a> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <{EX}b> .",)], "value string")
    g, _, _ = ntriples.import_merge(open_graph(spark, None), lines, "b")
    schema = "seq long, subject_uri string, predicate_type string, object_uri string"
    cmd = spark.createDataFrame([(1, EX + "a", "rdfs:subClassOf", thing)], schema)
    assert g.count() == 2
    gone = mut.delete_relationships(g, cmd)
    assert gone.count() == 1
    assert mut.add_relationships(gone, cmd)[0].count() == 2 and mut.add_relationships(g, cmd)[0].count() == 2
    rel = {r.object for r in ent.concept_relationships(g, EX + "a").collect()}
    assert rel == {thing, EX + "b"}
    typed = make_graph(spark, [("owl:Thing", "rdf:type", "rdfs:Class"), ("owl:Thing", "rdfs:comment", "top", "lit")])
    assert [tuple(r) for r in ent.concepts(typed, thing).collect()] == [(thing, None)]
    assert ent.concept_detail(typed, spark.createDataFrame([(thing,)], "uri string")).first().comment == "top"
    node = graphview.graph_nodes(typed).first()
    assert (node.id, node.label) == (thing, "Thing")


def test_writing_tasks_grow_with_the_graph(spark, tmp_path, monkeypatch):
    """A task of a snapshot's writer holds so many triples on average, however well they compress."""
    from ontocat.sources import store

    monkeypatch.setattr(store, "TASK_ROWS", 100)
    g = make_graph(spark, [(f"s{i // 2}", "rdfs:label", "same", "lit") for i in range(2_000)])
    path = store.write_graph(g.unionByName(g), f"{tmp_path}/graph", dedupe=True)
    files = {r[0] for r in store.open_graph(spark, path).select(F.input_file_name()).distinct().collect()}
    assert len(files) >= 10
    assert store.open_graph(spark, path).count() == 1_000
