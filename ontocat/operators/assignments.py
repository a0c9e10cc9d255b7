"""Assignment look-ups (J4, J5, F3) and concept-centred views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.model import Vocab, edges, instances, values
from ontocat.operators.entities import (concept_relationships, detail_of_present, full_iris, labels, present_subjects,
                                        request_batch, restrict)

V = Vocab


def table_assignments(g: DataFrame, table_uri=None, concept_uri=None) -> DataFrame:
    """``(table_uri, table_name, concept_uri, concept_name)``.

    No type check on either end; several names times several labels multiply.
    The catalog side (assignment edges, names) is large and the ontology side
    (labels) small: AQE broadcasts the label side when its measured size allows,
    and otherwise splits skewed concept keys (one concept on very many tables).
    """
    table_uri, concept_uri = request_batch(table_uri), request_batch(concept_uri)
    a = edges(g, V.CONCEPT_ASSIGNMENT, "table_uri", "concept_uri")
    a = restrict(restrict(a, "table_uri", table_uri), "concept_uri", concept_uri)
    names = restrict(values(g, V.NAME, "table_uri", "table_name"), "table_uri", table_uri)
    labs = restrict(labels(g, "concept_uri", "concept_name"), "concept_uri", concept_uri)
    return full_iris(a.join(names, "table_uri", "left").join(labs, "concept_uri", "left"), "table_uri", "concept_uri").select(
        "table_uri", "table_name", "concept_uri", "concept_name")


def column_assignments(g: DataFrame, column_uri=None, property_uri=None) -> DataFrame:
    """``(column_uri, column_name, property_uri, property_name)``."""
    column_uri, property_uri = request_batch(column_uri), request_batch(property_uri)
    a = edges(g, V.PROPERTY_ASSIGNMENT, "column_uri", "property_uri")
    a = restrict(restrict(a, "column_uri", column_uri), "property_uri", property_uri)
    names = restrict(values(g, V.NAME, "column_uri", "column_name"), "column_uri", column_uri)
    labs = restrict(labels(g, "property_uri", "property_name"), "property_uri", property_uri)
    return full_iris(a.join(names, "column_uri", "left").join(labs, "property_uri", "left"), "column_uri", "property_uri").select(
        "column_uri", "column_name", "property_uri", "property_name")


def assigned_objects(g: DataFrame, uris) -> DataFrame:
    """tables assigned to a concept plus columns assigned to a property.

    ``uris`` is one URI or a batch; the result carries the requested ``uri``.
    Rows of the two kinds have unlike shapes and are concatenated by name.
    """
    uris = request_batch(uris)
    t = table_assignments(g, concept_uri=uris).withColumn("uri", F.col("concept_uri"))
    c = column_assignments(g, property_uri=uris).withColumn("uri", F.col("property_uri"))
    return t.unionByName(c, allowMissingColumns=True).select(
        "uri", "table_uri", "table_name", "concept_uri", "concept_name",
        "column_uri", "column_name", "property_uri", "property_name")


def concept_properties(g: DataFrame, concept=None) -> DataFrame:
    """``(concept, uri, name, role)``: properties using a concept as domain or range.

    One row per role, so a property with the same domain and range appears twice.
    """
    props = instances(g, V.PROPERTY)
    names = labels(g, "uri", "name")
    concept = request_batch(concept)

    def role(pred: str, name: str) -> DataFrame:
        e = restrict(edges(g, pred, "uri", "concept"), "concept", concept)
        return full_iris(e.join(props, "uri", "left_semi").join(names, "uri", "left"), "concept", "uri").select(
            "concept", "uri", "name", F.lit(name).alias("role"))

    return role(V.DOMAIN, "domain").unionByName(role(V.RANGE, "range"))


def concept_summary(g: DataFrame, uris) -> DataFrame:
    """The concept page bundle for a batch of concepts.

    One row per existing concept: the E5 detail plus the number of outgoing
    relationships, assigned tables and related properties.
    The items themselves come from :func:`concept_summary_items`.
    """
    base = present_subjects(g, uris)
    detail = detail_of_present(g, base)
    rel, tab, prp = _summary_parts(g, base)
    parts = {"n_relationships": rel, "n_assigned_tables": tab, "n_properties": prp}
    # The three are counted by one aggregate: one join with the detail, so a task holds one more sorted side, not three.
    rows = reduce(DataFrame.unionByName, (part.select("uri", *[F.lit(int(n == name)).alias(n) for n in parts]) for name, part in parts.items()))
    counts = rows.groupBy("uri").agg(*[F.sum(n).alias(n) for n in parts])
    return detail.join(counts, "uri", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in parts})


def concept_summary_items(g: DataFrame, uris) -> DataFrame:
    """G4 items: ``(uri, section, item_uri, item_label, item_role)``, one row per item.

    Sections are ``relationship``, ``assigned_table`` and ``property``. No list
    is built, so a concept assigned to a huge number of tables is as many rows.
    """
    base = present_subjects(g, uris)
    rel, tab, prp = _summary_parts(g, base)

    def section(rows: DataFrame, name: str, uri: str, label: str, role) -> DataFrame:
        return rows.select("uri", F.lit(name).alias("section"), F.col(uri).alias("item_uri"),
                           F.col(label).alias("item_label"), role.alias("item_role"))

    return (section(rel, "relationship", "object", "object_label", F.col("predicate_type"))
            .unionByName(section(tab, "assigned_table", "table_uri", "table_name", F.lit("assignment")))
            .unionByName(section(prp, "property", "property_uri", "name", F.col("role"))))


def _summary_parts(g: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rel = concept_relationships(g, base)
    tab = table_assignments(g, concept_uri=base).withColumnRenamed("concept_uri", "uri")
    prp = concept_properties(g, base).withColumnRenamed("uri", "property_uri").withColumnRenamed("concept", "uri")
    return rel, tab, prp
