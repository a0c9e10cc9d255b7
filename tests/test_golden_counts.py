"""Golden counts of the derived graph and tag fixture at sf0.001 (FIXTURES.md §2, §3)."""

from pyspark.sql import functions as F

from ontocat.operators import assignments as asg
from ontocat.operators import entities as ent
from ontocat.operators import graphview, search, tagsync


def test_graph_size(graph_small):
    assert graph_small.count() == 6021
    assert graph_small.filter(F.col("o_kind") == "lit").count() == 2120


def test_entities(graph_small):
    c = ent.concepts(graph_small)
    assert c.count() == 236
    assert c.filter(F.col("label").isNull()).count() == 14
    p = ent.properties(graph_small)
    assert p.count() == 15
    assert p.filter(F.col("domain").isNotNull()).count() == 14
    t = ent.tables(graph_small)
    assert t.count() == 150
    assert t.filter(F.col("name").isNull()).count() == 3
    assert ent.columns(graph_small).count() == 1385


def test_alt_label_bag_vs_set(graph_small):
    bag = ent.concepts_alt_labels(graph_small, dedupe=False).filter("alt_label is not null").select(F.sum("n")).first()[0]
    clean = ent.concepts_alt_labels(graph_small, dedupe=True).filter("alt_label is not null").count()
    assert (bag, clean) == (231, 225)


def test_assignments_and_mapping(graph_small):
    ta = asg.table_assignments(graph_small)
    assert ta.count() == 240
    assert ta.filter(F.col("concept_name").isNull()).count() == 22
    assert asg.column_assignments(graph_small).count() == 1500
    m = tagsync.tag_mappings(graph_small)
    assert m.select("type", "name").distinct().count() == 1585
    assert m.select(F.sum("n")).first()[0] == 1663


def test_graph_view(graph_small):
    assert graphview.graph_nodes(graph_small).count() == 1786
    links = {r["type"]: r["count"] for r in graphview.graph_links(graph_small).groupBy("type").count().collect()}
    assert links == {"rdfs:subClassOf": 23, "skos:broader": 209, "domain": 14, "range": 6, "assignment": 238,
                     "propertyAssignment": 1385, "hasColumn": 1314}
    stats = {r["type"]: r["n"] for r in graphview.graph_stats(graph_small).collect()}
    assert stats == {"concept": 236, "property": 15, "table": 150, "column": 1385}


def test_search_hits(spark, graph_small):
    qs = spark.createDataFrame([(q,) for q in ("promo", "nation 1", "not specified", "customer 7", "brand 12")],
                               "query string")
    got = {r["query"]: r["count"] for r in search.trigram_search(graph_small, qs).groupBy("query").count().collect()}
    assert got == {"promo": 1, "nation 1": 55, "not specified": 2, "customer 7": 175, "brand 12": 68}


def _plan_counts(plan):
    return {(r["entity_type"], r["action"], r["skipped"]): r["count"]
            for r in plan.groupBy("entity_type", "action", "skipped").count().collect()}


def test_sync_plan(graph_small, tags_small):
    assert tags_small.count() == 5781
    mapping = tagsync.tag_mapping_pairs(graph_small)
    unmapped = tags_small.select("entity_type", "entity_name").distinct().join(
        mapping.select(F.col("type").alias("entity_type"), F.col("name").alias("entity_name")).distinct(),
        ["entity_type", "entity_name"], "left_anti")
    assert unmapped.count() == 52
    plan50 = tagsync.tag_sync_plan(mapping, tags_small, limit=50)
    assert plan50.count() == 2644
    c = _plan_counts(plan50)
    assert c == {("columns", "add", False): 725, ("columns", "delete", False): 483,
                 ("tables", "add", False): 173, ("tables", "delete", False): 1263}
    c25 = _plan_counts(tagsync.tag_sync_plan(mapping, tags_small, limit=25))
    assert (c25[("tables", "add", True)], c25[("tables", "delete", True)]) == (21, 124)
    c20 = _plan_counts(tagsync.tag_sync_plan(mapping, tags_small, limit=20))
    assert (c20[("tables", "add", True)], c20[("tables", "delete", True)]) == (117, 836)
