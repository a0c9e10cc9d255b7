"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the graph (or tags) Spark derives from the driver tables in
``sf_dir`` and runs the operator over all of it. Outputs use plain columns so
that they compare against the SQL in :mod:`ontocat.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontocat.model import Vocab, by_predicate
from ontocat.operators import assignments as asg
from ontocat.operators import entities as ent
from ontocat.operators import tagsync
from ontocat.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.graph(spark, sf_dir)


# ------------------------------------------------------------------ entities


@query("tables")
def q_tables(spark, sf_dir):
    return ent.tables(_g(spark, sf_dir))


@query("columns")
def q_columns(spark, sf_dir):
    return ent.columns(_g(spark, sf_dir))


@query("concepts")
def q_concepts(spark, sf_dir):
    return ent.concepts(_g(spark, sf_dir))


@query("properties")
def q_properties(spark, sf_dir):
    return ent.properties(_g(spark, sf_dir))


@query("concepts_alt_labels")
def q_concepts_alt_labels(spark, sf_dir):
    return ent.concepts_alt_labels(_g(spark, sf_dir), dedupe=True).drop("n")


@query("concepts_alt_labels_bag")
def q_concepts_alt_labels_bag(spark, sf_dir):
    return ent.concepts_alt_labels(_g(spark, sf_dir), dedupe=False)


@query("concept_alt_label_pairs")
def q_concept_alt_label_pairs(spark, sf_dir):
    return ent.concepts_alt_labels(_g(spark, sf_dir), dedupe=False)


@query("properties_alt_labels")
def q_properties_alt_labels(spark, sf_dir):
    return ent.properties_alt_labels(_g(spark, sf_dir))


# --------------------------------------------------------------- assignments


@query("table_assignments")
def q_table_assignments(spark, sf_dir):
    return asg.table_assignments(_g(spark, sf_dir))


@query("column_assignments")
def q_column_assignments(spark, sf_dir):
    return asg.column_assignments(_g(spark, sf_dir))


# ------------------------------------------------------------------ tag sync


@query("tag_mappings")
def q_tag_mappings(spark, sf_dir):
    return tagsync.tag_mappings(_g(spark, sf_dir))


@query("tag_mapping_pairs")
def q_tag_mapping_pairs(spark, sf_dir):
    return tagsync.tag_mapping_pairs(_g(spark, sf_dir))


@query("tag_sync_plan")
def q_tag_sync_plan(spark, sf_dir):
    g = _g(spark, sf_dir)
    return tagsync.tag_sync_plan(tagsync.tag_mapping_pairs(g), inputs.current_tags(spark, sf_dir))


@query("tag_sync_plan_limit25")
def q_tag_sync_plan_limit25(spark, sf_dir):
    g = _g(spark, sf_dir)
    return tagsync.tag_sync_plan(tagsync.tag_mapping_pairs(g), inputs.current_tags(spark, sf_dir), limit=25)


# ------------------------------------------------------- details and bundles


def _assigned_or_member_concepts(g: DataFrame) -> DataFrame:
    """Request batch for concept pages: every concept plus every assignment target."""
    targets = by_predicate(g, Vocab.CONCEPT_ASSIGNMENT).select(F.col("o").alias("uri"))
    return ent.concept_members(g).unionByName(targets)


@query("concept_detail")
def q_concept_detail(spark, sf_dir):
    g = _g(spark, sf_dir)
    return ent.concept_detail(g, _assigned_or_member_concepts(g))


@query("property_detail")
def q_property_detail(spark, sf_dir):
    g = _g(spark, sf_dir)
    targets = asg.column_assignments(g).select(F.col("property_uri").alias("uri"))
    return ent.property_detail(g, targets)


@query("concept_relationships")
def q_concept_relationships(spark, sf_dir):
    return ent.concept_relationships(_g(spark, sf_dir))


@query("alt_labels")
def q_alt_labels(spark, sf_dir):
    return ent.alt_labels(_g(spark, sf_dir))


@query("concept_properties")
def q_concept_properties(spark, sf_dir):
    return asg.concept_properties(_g(spark, sf_dir))


@query("concept_summary")
def q_concept_summary(spark, sf_dir):
    g = _g(spark, sf_dir)
    return asg.concept_summary(g, ent.concept_members(g))


@query("assigned_objects")
def q_assigned_objects(spark, sf_dir):
    g = _g(spark, sf_dir)
    return asg.assigned_objects(g, ent.concept_members(g).unionByName(ent.property_members(g)))


# -------------------------------------------------------------------- search

# The search and list-filter strings of the test plan.
SEARCH_QUERIES = ("promo", "nation 1", "not specified", "customer 7", "brand 12")
SEARCH_KINDS = ("concept", "property", "all")
LIST_FILTERS = ("asia", "none", "pr/", "customer#00000001", "alt ")


@query("trigram_search")
def q_trigram_search(spark, sf_dir):
    from ontocat.operators import search

    qs = spark.createDataFrame([(q,) for q in SEARCH_QUERIES], "query string")
    return search.trigram_search(_g(spark, sf_dir), qs)


@query("trigram_search_kind")
def q_trigram_search_kind(spark, sf_dir):
    from ontocat.operators import search

    qs = spark.createDataFrame([(q, k) for q in SEARCH_QUERIES for k in SEARCH_KINDS], "query string, kind string")
    return search.trigram_search_kind(_g(spark, sf_dir), qs)


@query("list_filter")
def q_list_filter(spark, sf_dir):
    from ontocat.operators import search

    fs = spark.createDataFrame([(q,) for q in LIST_FILTERS], "q string")
    return search.list_filter(_g(spark, sf_dir), fs)


# ---------------------------------------------------------------- graph view


@query("graph_nodes")
def q_graph_nodes(spark, sf_dir):
    from ontocat.operators import graphview

    return graphview.graph_nodes(_g(spark, sf_dir))


@query("graph_links")
def q_graph_links(spark, sf_dir):
    from ontocat.operators import graphview

    return graphview.graph_links(_g(spark, sf_dir))


@query("has_column")
def q_has_column(spark, sf_dir):
    from ontocat.operators import graphview

    return graphview.has_column(_g(spark, sf_dir))


@query("graph_stats")
def q_graph_stats(spark, sf_dir):
    from ontocat.operators import graphview

    return graphview.graph_stats(_g(spark, sf_dir))


# ----------------------------------------------------------------- mutations


def _graph_out(g: DataFrame) -> DataFrame:
    return g.select("s", "p", "o", "o_kind")


@query("upsert_tables")
def q_upsert_tables(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.upsert_tables(_g(spark, sf_dir), commands.table_commands(spark, sf_dir)))


@query("upsert_columns")
def q_upsert_columns(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.upsert_columns(_g(spark, sf_dir), commands.column_commands(spark, sf_dir)))


@query("register_inventory")
def q_register_inventory(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.register_inventory(_g(spark, sf_dir), commands.inventory(spark, sf_dir)))


@query("insert_concepts")
def q_insert_concepts(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    g, _ = mut.insert_concepts(_g(spark, sf_dir), commands.concept_inserts(spark, sf_dir))
    return _graph_out(g)


@query("insert_concepts_rejected")
def q_insert_concepts_rejected(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    _, rejected = mut.insert_concepts(_g(spark, sf_dir), commands.concept_inserts(spark, sf_dir))
    return rejected.select("seq", "uri", "label", "type")


@query("insert_properties")
def q_insert_properties(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.insert_properties(_g(spark, sf_dir), commands.property_inserts(spark, sf_dir)))


@query("update_concepts")
def q_update_concepts(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.update_concepts(_g(spark, sf_dir), commands.concept_updates(spark, sf_dir)))


@query("update_properties")
def q_update_properties(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.update_properties(_g(spark, sf_dir), commands.property_updates(spark, sf_dir)))


@query("add_relationships")
def q_add_relationships(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    g, _ = mut.add_relationships(_g(spark, sf_dir), commands.relationship_adds(spark, sf_dir))
    return _graph_out(g)


@query("add_relationships_rejected")
def q_add_relationships_rejected(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    _, rejected = mut.add_relationships(_g(spark, sf_dir), commands.relationship_adds(spark, sf_dir))
    return rejected.select("seq", "subject_uri", "predicate_type", "object_uri")


@query("delete_relationships")
def q_delete_relationships(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.delete_relationships(_g(spark, sf_dir), commands.relationship_deletes(spark, sf_dir)))


@query("delete_relationships_rejected")
def q_delete_relationships_rejected(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    change = mut.relationship_delete_changes(_g(spark, sf_dir), commands.relationship_deletes(spark, sf_dir))
    return change.rejected.select("seq", "subject_uri", "predicate_type", "object_uri")


@query("assign_concepts")
def q_assign_concepts(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.assign_concepts(_g(spark, sf_dir), commands.concept_assignment_commands(spark, sf_dir)))


@query("assign_properties")
def q_assign_properties(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.assign_properties(_g(spark, sf_dir), commands.property_assignment_commands(spark, sf_dir)))


@query("command_log")
def q_command_log(spark, sf_dir):
    """U1-U11 as one ordered log of mixed commands."""
    from ontocat.operators.command_log import apply_log
    from ontocat.sources import commands

    return _graph_out(apply_log(_g(spark, sf_dir), commands.mixed_log(spark, sf_dir))[0])


@query("command_log_rejected")
def q_command_log_rejected(spark, sf_dir):
    from ontocat.operators.command_log import events
    from ontocat.sources import commands

    return events(commands.mixed_log(spark, sf_dir))[1].select("seq", "kind")


def _kept_mapping(spark, sf_dir):
    """The mapping of the graph after the mixed log, from that before it and what the log changes."""
    from ontocat.operators import tagdelta
    from ontocat.operators.command_log import log_changes
    from ontocat.sources import commands

    g = _g(spark, sf_dir)
    delta = tagdelta.mapping_delta(g, tagdelta.graph_delta(g, log_changes(g, commands.mixed_log(spark, sf_dir))))
    return tagdelta.merge_mapping(tagsync.tag_mappings(g), delta), delta


@query("tag_mappings_kept")
def q_tag_mappings_kept(spark, sf_dir):
    return _kept_mapping(spark, sf_dir)[0].select("name", "type", "tag", "n")


@query("tag_sync_changed")
def q_tag_sync_changed(spark, sf_dir):
    """The sync plan of the entities that the mixed log has changed."""
    from ontocat.operators import tagdelta

    mapping, delta = _kept_mapping(spark, sf_dir)
    return tagdelta.changed_plan(mapping, delta, inputs.current_tags(spark, sf_dir))


@query("snapshot_log")
def q_snapshot_log(spark, sf_dir):
    """Two writers plan on the same snapshot of a log; the graph that their commits give."""
    from ontocat.operators import mutations as mut
    from ontocat.session import new_snapshot_path
    from ontocat.sources import commands
    from ontocat.sources.snapshot_log import GraphLog

    log = GraphLog(spark, new_snapshot_path(spark, "graph-log"))
    log.start(_g(spark, sf_dir))

    def overtaken(g):
        if log.latest().number == 0:  # another writer commits while this one plans
            log.commit(lambda h: mut.property_assignment_changes(h, commands.property_assignment_commands(spark, sf_dir)))
        return mut.concept_assignment_changes(g, commands.concept_assignment_commands(spark, sf_dir))

    log.commit(overtaken)
    return _graph_out(log.open())


@query("delete_objects")
def q_delete_objects(spark, sf_dir):
    from ontocat.operators import mutations as mut
    from ontocat.sources import commands

    return _graph_out(mut.delete_objects(_g(spark, sf_dir), commands.delete_commands(spark, sf_dir)))


# ------------------------------------------------------- import / export, scalars

IMPORT_BATCH = "imp"
#: What the relative IRIs of the derived graph become when its Turtle is read.
EXPORT_BASE = "http://example.com/data/"


def _import(spark, sf_dir):
    from ontocat.sources import commands, ntriples

    return ntriples.import_merge(_g(spark, sf_dir), commands.ntriples_lines(spark, sf_dir), IMPORT_BATCH)


@query("import_merge")
def q_import_merge(spark, sf_dir):
    _, added, _ = _import(spark, sf_dir)
    return added


@query("import_merged_graph")
def q_import_merged_graph(spark, sf_dir):
    merged, _, _ = _import(spark, sf_dir)
    return merged


@query("import_rejects")
def q_import_rejects(spark, sf_dir):
    from ontocat.sources import commands, ntriples

    return ntriples.rejected_lines(commands.ntriples_lines(spark, sf_dir))


def _turtle(spark, sf_dir):
    from ontocat.sources import commands, turtle

    return turtle.parse_turtle(commands.turtle_lines(spark, sf_dir), IMPORT_BATCH)


@query("import_turtle")
def q_import_turtle(spark, sf_dir):
    """The triples of Turtle files that the graph does not hold; a blank node shows as ``_:``, as its label is made up."""
    from ontocat.sources import commands, turtle

    _, added, _ = turtle.import_turtle(_g(spark, sf_dir), commands.turtle_lines(spark, sf_dir), IMPORT_BATCH)
    return added.select(*[F.when(F.startswith(F.col(c), F.lit("_:")), F.lit("_:")).otherwise(F.col(c)).alias(c) if c in ("s", "o") else F.col(c)
                          for c in added.columns])


@query("import_turtle_rejects")
def q_import_turtle_rejects(spark, sf_dir):
    _, rejects = _turtle(spark, sf_dir)
    return rejects


@query("export_triples")
def q_export_triples(spark, sf_dir):
    from ontocat.sources import ntriples

    return ntriples.export_lines(_g(spark, sf_dir))


@query("export_turtle")
def q_export_turtle(spark, sf_dir):
    """S3: the triples that Turtle import reads from the graph's Turtle files, which are made relative to a base."""
    from ontocat.session import new_snapshot_path
    from ontocat.sources import turtle, turtle_export

    path = turtle_export.export_turtle(_g(spark, sf_dir), new_snapshot_path(spark, "turtle"), base=EXPORT_BASE)
    triples, _ = turtle.parse_turtle(turtle.read_turtle(spark, path), IMPORT_BATCH, parts=True)
    return triples


@query("literal_decode")
def q_literal_decode(spark, sf_dir):
    from ontocat.functions.scalars import literal_value

    merged, _, _ = _import(spark, sf_dir)
    vals = literal_value(F.col("o"), F.when(F.col("o_kind") == "lit", F.col("o_datatype")))
    return merged.select("s", "p", "o", "o_kind", "o_datatype", *[c.alias(n) for n, c in vals.items()])


@query("mint_iri")
def q_mint_iri(spark, sf_dir):
    from ontocat.functions.scalars import mint_iri
    from ontocat.sources import commands

    return commands.scalar_names(spark, sf_dir).select("name", mint_iri(F.col("name")).alias("iri"))


@query("mint_iri_parts")
def q_mint_iri_parts(spark, sf_dir):
    from ontocat.functions.scalars import mint_iri_parts
    from ontocat.sources import commands

    return commands.scalar_names(spark, sf_dir).select(
        "catalog", "schema", "tbl", mint_iri_parts("catalog", "schema", "tbl").alias("iri"))


@query("qualified_names")
def q_qualified_names(spark, sf_dir):
    from ontocat.functions.scalars import qualified_name
    from ontocat.sources import commands

    inv = commands.inventory(spark, sf_dir)
    return inv.select(qualified_name("catalog", "schema", "table").alias("table_name"),
                      F.when(F.col("column").isNotNull(), qualified_name("catalog", "schema", "table", "column"))
                      .alias("column_name"))


def _graph_iris(g: DataFrame) -> DataFrame:
    from ontocat.functions.scalars import export_form

    s = g.filter(~F.startswith(F.col("s"), F.lit("_:"))).select(F.col("s").alias("t"))
    p = g.select(F.col("p").alias("t"))
    o = g.filter(F.col("o_kind") == "iri").select(F.col("o").alias("t"))
    return s.unionByName(p).unionByName(o).distinct().select(export_form(F.col("t")).alias("iri")).distinct()


@query("local_name")
def q_local_name(spark, sf_dir):
    from ontocat.functions.scalars import local_name

    return _graph_iris(_g(spark, sf_dir)).select("iri", local_name(F.col("iri")).alias("local_name"))


@query("predicate_qname")
def q_predicate_qname(spark, sf_dir):
    from ontocat.functions.scalars import compact_iri

    return _graph_iris(_g(spark, sf_dir)).select("iri", compact_iri(F.col("iri")).alias("qname"))


@query("expand_curie")
def q_expand_curie(spark, sf_dir):
    from ontocat.functions.scalars import expand_curie
    from ontocat.sources import commands

    g = _g(spark, sf_dir)
    curies = g.select(F.col("p").alias("curie")).unionByName(
        commands.relationship_adds(spark, sf_dir).select(F.col("predicate_type").alias("curie"))).distinct()
    return curies.select("curie", expand_curie(F.col("curie")).alias("iri"))


def _namespace_table(spark, sf_dir) -> DataFrame:
    """Bindings ``(prefix, iri)``: the graph's own, one nested in another per supplier, and brands bound to several types."""
    from ontocat.model import DEFAULT_NAMESPACES
    from ontocat.sources.fixtures import read_table

    own = spark.createDataFrame(sorted(DEFAULT_NAMESPACES.items()), "prefix string, iri string")
    nested = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("prefix"), F.concat(F.lit("t/"), F.col("s_suppkey")).alias("iri"))
    brands = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("prefix"), F.concat(F.lit("ty/"), F.col("p_type")).alias("iri"))
    return own.unionByName(nested).unionByName(brands)


@query("namespace_names")
def q_namespace_names(spark, sf_dir):
    """P4 / P5 by a table of namespaces: every IRI of the graph, its name by the longest one, and what the name expands to."""
    from ontocat.operators import namespaces

    valid, _ = namespaces.bindings(_namespace_table(spark, sf_dir))
    names = namespaces.compact_iris(_graph_iris(_g(spark, sf_dir)), valid)
    back = namespaces.expand_curies(names.select(F.col("iri").alias("of"), F.col("qname").alias("curie")), valid)
    return back.select(F.col("of").alias("iri"), F.col("curie").alias("qname"), F.col("iri").alias("expanded"))


@query("namespace_conflicts")
def q_namespace_conflicts(spark, sf_dir):
    from ontocat.operators import namespaces

    return namespaces.bindings(_namespace_table(spark, sf_dir))[1]


@query("entity_by_uri")
def q_entity_by_uri(spark, sf_dir):
    from ontocat.sources.fixtures import read_table

    batch = read_table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.concat(F.lit("t/"), F.col("c_custkey")).alias("uri"))
    return ent.tables(_g(spark, sf_dir), uri=batch)


@query("tag_changes_from_json")
def q_tag_changes_from_json(spark, sf_dir):
    """S6 + G1 + S7: the mapping handed off as JSON, read back, planned, emitted as a change table."""
    from ontocat.session import new_snapshot_path

    path = new_snapshot_path(spark, "mappings-json")
    tagsync.mappings_to_json(tagsync.tag_mapping_pairs(_g(spark, sf_dir))).write.mode("errorifexists").json(path)
    mapping = tagsync.mappings_from_json(spark.read.schema(tagsync.MAPPING_JSON_SCHEMA).json(path))
    plan = tagsync.tag_sync_plan(mapping, inputs.current_tags(spark, sf_dir))
    return tagsync.change_table(plan)


@query("tag_sync_applied")
def q_tag_sync_applied(spark, sf_dir):
    """The tags of a catalog after the journaled sink has applied the stored change table, then found nothing left to do."""
    from ontocat.session import new_snapshot_path
    from ontocat.sources.tag_sink import FolderTarget, apply_changes

    tags, table, journal = (new_snapshot_path(spark, kind) for kind in ("tags", "tag-changes", "tag-journal"))
    current = inputs.current_tags(spark, sf_dir)
    FolderTarget.start(current, tags)
    tagsync.change_table(tagsync.tag_sync_plan(tagsync.tag_mapping_pairs(_g(spark, sf_dir)), current)).write.parquet(table)
    for _ in range(2):  # a second start finds every chunk in the journal
        apply_changes(spark.read.parquet(table), FolderTarget(tags, 0), journal)
    return FolderTarget.tags(spark, tags)


@query("concept_summary_items")
def q_concept_summary_items(spark, sf_dir):
    g = _g(spark, sf_dir)
    return asg.concept_summary_items(g, ent.concept_members(g))
