"""Hand-built graphs for the reference's surprising semantics."""

from pyspark.sql import functions as F

from conftest import make_graph
from ontocat.operators import assignments as asg
from ontocat.operators import entities as ent
from ontocat.operators import graphview, search, tagsync

EX = "http://example.org/zoo/"


def z(x):
    return EX + x


def test_owl_class_alone_is_not_a_concept(spark):
    g = make_graph(spark, [
        (z("Engine"), "rdf:type", "owl:Class"),
        (z("Fan"), "rdf:type", "owl:Class"), (z("Fan"), "rdfs:subClassOf", z("Engine")),
        (z("Fan"), "rdfs:label", "Fan", "lit"),
    ])
    assert [r.uri for r in ent.concepts(g).collect()] == [z("Fan")]
    # The hierarchy edge points at a non-concept, so no link survives.
    assert graphview.graph_links(g).count() == 0


def test_rdfs_property_is_not_rdf_property(spark):
    g = make_graph(spark, [(z("name"), "rdf:type", "rdfs:Property"), (z("name"), "rdfs:label", "Name", "lit")])
    assert ent.properties(g).count() == 0


def test_type_match_is_case_sensitive_and_only_known_assignment(spark):
    g = make_graph(spark, [
        (z("t1"), "rdf:type", "uc:table"), (z("t1"), "uc:name", "a.b.c", "lit"),
        (z("t1"), "uc:semanticAssignment", z("Dog")),
    ])
    assert ent.tables(g).count() == 0
    assert asg.table_assignments(g).count() == 0


def test_alt_label_repeats_per_membership_branch(spark):
    g = make_graph(spark, [
        (z("Dog"), "rdf:type", "rdfs:Class"), (z("Dog"), "rdfs:subClassOf", z("Animal")),
        (z("Dog"), "rdfs:label", "Dog", "lit"), (z("Dog"), "skos:altLabel", "Hund", "lit"),
        (z("Animal"), "rdf:type", "rdfs:Class"),
    ])
    bag = {r.uri: (r.alt_label, r.n) for r in ent.concepts_alt_labels(g, dedupe=False).collect()}
    clean = {r.uri: (r.alt_label, r.n) for r in ent.concepts_alt_labels(g, dedupe=True).collect()}
    assert bag == {z("Dog"): ("Hund", 2), z("Animal"): (None, 1)}
    assert clean == {z("Dog"): ("Hund", 1), z("Animal"): (None, 1)}


def test_domain_visibility_differs_between_list_and_detail(spark):
    g = make_graph(spark, [
        (z("p"), "rdf:type", "rdf:Property"), (z("p"), "rdfs:label", "P", "lit"),
        (z("p"), "rdfs:domain", z("Unlabelled")),
    ])
    lst = ent.properties(g).first()
    det = ent.property_detail(g, [z("p")]).first()
    assert lst.domain is None
    assert det.domain == z("Unlabelled") and det.domain_label is None


def test_concept_detail_first_solution_is_deterministic(spark):
    g = make_graph(spark, [
        (z("C"), "rdf:type", "owl:Class"), (z("C"), "rdf:type", "rdfs:Class"),
        (z("C"), "rdfs:label", "b", "lit"), (z("C"), "rdfs:label", "a", "lit"),
        (z("C"), "skos:altLabel", "y", "lit"), (z("C"), "skos:altLabel", "x", "lit"),
    ])
    d = ent.concept_detail(g, [z("C"), z("missing")]).collect()
    assert len(d) == 1
    assert (d[0].label, d[0].type, d[0].n_alt_labels) == ("a", "http://www.w3.org/2000/01/rdf-schema#Class", 2)
    assert {r.alt_label for r in ent.alt_labels(g, [z("C")]).collect()} == {"x", "y"}


def test_mapping_groups_by_name_and_drops_dangling(spark):
    g = make_graph(spark, [
        (z("t1"), "rdf:type", "uc:Table"), (z("t1"), "uc:name", "c.s.t", "lit"),
        (z("t2"), "rdf:type", "uc:Table"), (z("t2"), "uc:name", "c.s.t", "lit"),
        (z("t1"), "uc:conceptAssignment", z("A")), (z("t2"), "uc:conceptAssignment", z("B")),
        (z("t2"), "uc:conceptAssignment", z("gone")),
        (z("A"), "rdfs:label", "Alpha", "lit"), (z("B"), "rdfs:label", "Alpha", "lit"),
    ])
    rows = tagsync.tag_mappings(g).collect()
    assert [(r.name, r.type, r.tag, r.n) for r in rows] == [("c.s.t", "tables", "Alpha", 2)]


def test_sync_plan_rules(spark):
    mapping = spark.createDataFrame(
        [("tables", "a", "X"), ("tables", "a", "X"), ("tables", "a", "Y"), ("tables", "b", "Z")],
        "type string, name string, tag string")
    current = spark.createDataFrame(
        [("tables", "a", "TYPE_X"), ("tables", "a", "TYPE_OLD"), ("tables", "a", "TYPEX"),
         ("tables", "a", "OTHER_1"), ("tables", "b", "OTHER_1"), ("tables", "b", "OTHER_2"),
         ("tables", "stale", "TYPE_Q")],
        "entity_type string, entity_name string, tag_key string")
    plan = {(r.entity_name, r.tag_key): (r.action, r.skipped)
            for r in tagsync.tag_sync_plan(mapping, current, limit=50).collect()}
    # TYPEX does not carry the prefix; unmapped "stale" is never visited.
    assert plan == {("a", "TYPE_Y"): ("add", False), ("a", "TYPE_OLD"): ("delete", False),
                    ("b", "TYPE_Z"): ("add", False)}
    # Guard: 4 current (any prefix) + 1 add - 1 delete = 4 >= 4 -> entity a skipped, deletes too.
    plan4 = {(r.entity_name, r.tag_key): (r.action, r.skipped)
             for r in tagsync.tag_sync_plan(mapping, current, limit=4).collect()}
    assert plan4[("a", "TYPE_OLD")] == ("delete", True) and plan4[("a", "TYPE_Y")] == ("add", True)
    assert plan4[("b", "TYPE_Z")] == ("add", False)  # 2 + 1 - 0 = 3 < 4
    plan3 = {(r.entity_name, r.tag_key): (r.action, r.skipped)
             for r in tagsync.tag_sync_plan(mapping, current, limit=3).collect()}
    assert plan3[("b", "TYPE_Z")] == ("add", True)  # 3 >= 3: the limit itself is already too many


def test_sync_plan_is_idempotent_after_apply(spark, graph_small, tags_small):
    mapping = tagsync.tag_mapping_pairs(graph_small)
    plan = tagsync.tag_sync_plan(mapping, tags_small, limit=25)
    after = tagsync.apply_plan(tags_small, plan)
    replan = tagsync.tag_sync_plan(mapping, after, limit=25)
    skipped = plan.filter("skipped").select("entity_type", "entity_name").distinct()
    live = replan.join(skipped, ["entity_type", "entity_name"], "left_anti")
    assert live.count() == 0


def test_search_covers_all_literals_and_bnodes(spark):
    g = make_graph(spark, [
        (z("Dog"), "rdfs:label", "Dog", "lit"), (z("Dog"), "rdfs:comment", "a dog's life", "lit"),
        ("_:b1", "rdfs:label", "Dogs", "lit"), (z("Cat"), "rdfs:label", "Cat", "lit"),
    ])
    qs = spark.createDataFrame([("dog",)], "query string")
    got = sorted((r.uri, r.text) for r in search.trigram_search(g, qs).collect())
    assert got == [("_:b1", "Dogs"), (z("Dog"), "Dog"), (z("Dog"), "a dog's life")]


def test_sync_plan_include_unmapped(spark):
    mapping = spark.createDataFrame([("tables", "a", "X")], "type string, name string, tag string")
    current = spark.createDataFrame([("tables", "stale", "TYPE_Q"), ("tables", "stale", "OTHER")],
                                    "entity_type string, entity_name string, tag_key string")
    default = tagsync.tag_sync_plan(mapping, current).collect()
    assert [(r.entity_name, r.tag_key, r.action) for r in default] == [("a", "TYPE_X", "add")]
    wide = sorted((r.entity_name, r.tag_key, r.action)
                  for r in tagsync.tag_sync_plan(mapping, current, include_unmapped=True).collect())
    assert wide == [("a", "TYPE_X", "add"), ("stale", "TYPE_Q", "delete")]


def test_detail_finds_subjects_outside_the_ontology_partitions(spark):
    from ontocat.sources.store import snapshot

    g = snapshot(spark, make_graph(spark, [
        (z("t"), "uc:name", "a.b.c", "lit"),             # catalog predicate only
        (z("c"), "rdfs:label", "C", "lit"),              # ontology predicate
        (z("x"), "http://example.org/custom", "v", "lit"),  # predicate outside the vocabulary
    ]))
    got = sorted(r.uri for r in ent.concept_detail(g, [z("t"), z("c"), z("x"), z("nope")]).collect())
    assert got == [z("c"), z("t"), z("x")]
    only_ontology = [r.uri for r in ent.concept_detail(g, [z("c")]).collect()]
    assert only_ontology == [z("c")]


def test_tasks_are_bounded_unless_the_session_has_its_own_size(spark):
    from conftest import SF_SMALL
    from ontocat.plans import inputs
    from ontocat.session import TASK_BYTES

    key, size = TASK_BYTES
    old = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        inputs.graph(spark, SF_SMALL)
        assert spark.conf.get(key) == size
        spark.conf.set(key, "2m")
        inputs.current_tags(spark, SF_SMALL)
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
