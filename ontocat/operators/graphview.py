"""Node/link graph assembly (G5, G6), table->column by name (J8) and node counts (A4).

The reference gathers the entity lists with one query per concept and per
column, then joins them in the browser against a growing set of node ids.
Here each link kind is a semi-join of its edge rows against the node ids that
were known when that kind was added, all in one plan:

* hierarchy links: target must be a concept;
* domain / range: target must be a concept (a property as domain depended on
  list order in the reference and is not accepted);
* assignment: both ends among concepts, properties and tables;
* hasColumn: J8;
* propertyAssignment: typed columns only, both ends among all nodes.

Links are distinct on ``(source, target, type)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.functions.scalars import display_label, uri_component
from ontocat.model import Vocab, by_predicate, edges, instances
from ontocat.operators import entities as ent
from ontocat.operators.joins import broadcast_if_bounded

NODE_TYPES = ("concept", "property", "table", "column")
# The pages that nodes link to.
_PAGES = {"concept": "/concepts?concept_uri=", "property": "/properties?property_uri=",
          "table": "/tables?table_uri=", "column": "/columns?column_uri="}


def _nodes(df: DataFrame, label_col: str, kind: str) -> DataFrame:
    return df.select(
        F.col("uri").alias("id"),
        display_label(F.col(label_col), F.col("uri")).alias("label"),
        F.lit(kind).alias("type"),
        F.concat(F.lit(_PAGES[kind]), uri_component(F.col("uri"))).alias("url"),
    )


def graph_nodes(g: DataFrame) -> DataFrame:
    """``(id, label, type, url)``; one node per entity-list row, duplicates kept."""
    return (
        _nodes(ent.concepts(g), "label", "concept")
        .unionByName(_nodes(ent.properties(g), "name", "property"))
        .unionByName(_nodes(ent.tables(g), "name", "table"))
        .unionByName(_nodes(ent.columns(g), "name", "column"))
    )


def has_column(g: DataFrame) -> DataFrame:
    """``(table_uri, column_uri)`` by name: a column named ``a.b.c.d...`` (at least
    four dot-separated parts, after the local-name fallback) belongs to the table
    named ``a.b.c``; when several tables share that name the smallest URI wins."""
    cols = ent.columns(g).select(
        F.col("uri").alias("column_uri"),
        F.split(display_label(F.col("name"), F.col("uri")), r"\.").alias("parts"),
    )
    cols = cols.filter(F.size("parts") >= 4).select(
        "column_uri", F.array_join(F.slice("parts", 1, 3), ".").alias("table_name"))
    # One row per table name before the join: the column side can be hot on a
    # name, the table side cannot.
    tabs = (
        ent.tables(g).filter(F.col("name").isNotNull())
        .groupBy(F.col("name").alias("table_name")).agg(F.min("uri").alias("table_uri"))
    )
    return cols.join(tabs, "table_name").select("table_uri", "column_uri")


def graph_links(g: DataFrame) -> DataFrame:
    """``(source, target, type)``.

    Built from the bare edges; names are read for ``hasColumn`` alone and labels
    only to know which domains and ranges have one. Targets are few and may be
    hot (a property on a third of all columns), so it is the distinct targets
    that are held against the node ids, and the edges are then filtered by the
    small set that is left.
    """
    V = Vocab
    concepts, props = ent.concept_members(g), ent.property_members(g)
    # Only ever the right side of semi-joins, so no dedupe (and no shuffle for it).
    early = concepts.unionByName(props).unionByName(instances(g, V.TABLE))
    typed_columns = instances(g, V.COLUMN)

    def source_in(df: DataFrame, ids: DataFrame) -> DataFrame:
        return df.join(ids.withColumnRenamed("uri", "source"), "source", "left_semi")

    def target_in(df: DataFrame, ids: DataFrame) -> DataFrame:
        known = df.select("target").distinct().join(ids.withColumnRenamed("uri", "target"), "target", "left_semi")
        return df.join(broadcast_if_bounded(known), "target", "left_semi")

    rel = by_predicate(g, *V.HIERARCHY).filter("o != ''").select(
        F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("type"))
    hier = source_in(target_in(rel, concepts), concepts)

    def of_property(pred: str, name: str) -> DataFrame:
        labelled = concepts.join(ent.labels(g), "uri", "left_semi")
        return source_in(target_in(edges(g, pred, "source", "target"), labelled), props).withColumn("type", F.lit(name))

    assigned = edges(g, V.CONCEPT_ASSIGNMENT, "source", "target")
    assign = source_in(target_in(assigned, early), early).withColumn("type", F.lit("assignment"))
    on_columns = edges(g, V.PROPERTY_ASSIGNMENT, "source", "target")
    passign = source_in(target_in(on_columns, early.unionByName(typed_columns)), typed_columns).withColumn(
        "type", F.lit("propertyAssignment"))
    linked = [hier, of_property(V.DOMAIN, "domain"), of_property(V.RANGE, "range"), assign, passign]
    out = has_column(g).select(F.col("table_uri").alias("source"), F.col("column_uri").alias("target"),
                               F.lit("hasColumn").alias("type"))
    for more in linked:
        out = out.unionByName(more.select("source", "target", "type"))
    return ent.full_iris(out.distinct(), "source", "target")


def graph_stats(g: DataFrame) -> DataFrame:
    """A4: ``(type, n)`` node counts for the four node types, zero when absent."""
    counts = graph_nodes(g).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    types = g.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in NODE_TYPES])).alias("type"))
    return types.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

