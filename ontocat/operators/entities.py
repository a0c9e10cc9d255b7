"""Entity scans (E1-E8) and synonym aggregates (A1, A2).

Graph pattern -> DataFrame mapping used throughout:

* a triple pattern with a fixed predicate is a predicate scan (partition
  pruning on stored graphs);
* ``OPTIONAL {...}`` is a left outer equi-join on the shared variable;
* ``UNION`` is ``unionByName`` (a bag), ``DISTINCT`` is ``distinct``;
* a fixed variable (``initBindings``) is :func:`restrict`, a filter for one
  value and a semi-join for a batch.

Synonyms and other lists are long rows, one per value, at every size; detail
rows carry counts, never lists, so an entity with very many values stays one
detail row and no list has to fit in a row or a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontocat.functions.scalars import expand_curie, export_form, store_form
from ontocat.model import (CATALOG_CLASSES, IRI, KNOWN_CLASSES, PK, Vocab, by_predicate, edges, instances, storage_keys,
                           values)
from ontocat.operators.joins import broadcast_if_bounded

V = Vocab


def request_batch(uris: DataFrame | str | Iterable[str] | None):
    """Prepare a batch of URIs: stored form, distinct, size-checked and, when
    bounded, broadcast, so every scan it filters is streamed past it instead of
    being shuffled. Constants pass through unchanged."""
    if not isinstance(uris, DataFrame) or getattr(uris, "_prepared_batch", False):
        return uris
    key = uris.columns[0]
    batch = broadcast_if_bounded(uris.select(store_form(F.col(key)).alias("uri")).distinct())
    batch._prepared_batch = True  # already in stored form, distinct, checked and (if bounded) broadcast
    return batch


def restrict(df: DataFrame, col: str, uris: str | Iterable[str] | DataFrame | None) -> DataFrame:
    """Fix one variable to a value, a list of values or a DataFrame of values.

    A DataFrame batch becomes a left semi-join (its single column is the key;
    prepare it with :func:`request_batch` to broadcast it behind a size check).
    """
    if uris is None:
        return df
    if isinstance(uris, str):
        return df.filter(F.col(col) == store_form(F.lit(uris)))
    if isinstance(uris, DataFrame):
        key = uris.columns[0]
        if not getattr(uris, "_prepared_batch", False):
            uris = uris.select(store_form(F.col(key)).alias(key))
        batch = uris if key == col else uris.withColumnRenamed(key, col)
        return df.join(batch, col, "left_semi")
    return df.filter(F.col(col).isin([store_form(F.lit(u)) for u in uris]))


def full_iris(df: DataFrame, *cols: str) -> DataFrame:
    """Outgoing IRI columns in full (vocabulary terms are stored compact)."""
    return df.withColumns({c: export_form(c) for c in cols})


def labels(g: DataFrame, col: str = "uri", out: str = "label") -> DataFrame:
    return values(g, V.LABEL, col, out)


# ---------------------------------------------------------------- E1 / E2


def tables(g: DataFrame, uri=None) -> DataFrame:
    """``(uri, name)`` per table; one row per name, no DISTINCT."""
    uri = request_batch(uri)
    t = restrict(instances(g, V.TABLE), "uri", uri)
    return full_iris(t.join(restrict(values(g, V.NAME, "uri", "name"), "uri", uri), "uri", "left"), "uri")


def columns(g: DataFrame, uri=None) -> DataFrame:
    """``(uri, name)`` per column."""
    uri = request_batch(uri)
    c = restrict(instances(g, V.COLUMN), "uri", uri)
    return full_iris(c.join(restrict(values(g, V.NAME, "uri", "name"), "uri", uri), "uri", "left"), "uri")


# ---------------------------------------------------------------- E3 / A1


def concept_members(g: DataFrame, bag: bool = False) -> DataFrame:
    """Concept membership: typed ``rdfs:Class`` OR subject of ``rdfs:subClassOf`` OR typed
    ``skos:Concept``. ``bag=True`` keeps one row per matching branch solution."""
    u = (instances(g, V.CLASS).unionByName(by_predicate(g, V.SUBCLASS_OF).select(F.col("s").alias("uri")))
         .unionByName(instances(g, V.CONCEPT)))
    return u if bag else u.distinct()


def concepts(g: DataFrame, uri=None) -> DataFrame:
    """DISTINCT ``(uri, label)``; unlabelled concepts have a NULL label."""
    uri = request_batch(uri)
    m = restrict(concept_members(g), "uri", uri)
    return full_iris(m.join(restrict(labels(g), "uri", uri), "uri", "left").distinct(), "uri")


def concepts_alt_labels(g: DataFrame, dedupe: bool = True) -> DataFrame:
    """A1: ``(uri, label, alt_label, n)``, one row per value; a concept without any has a NULL one.

    ``n`` is the multiplicity: with ``dedupe=False``, the faithful bag, a
    concept matching k membership branches has every alt label k times.
    """
    alts = values(g, V.ALT_LABEL, "uri", "alt_label")
    members = concept_members(g, bag=not dedupe)
    rows = members.join(labels(g), "uri", "left").join(alts, "uri", "left")
    if dedupe:
        rows = rows.distinct()
    return full_iris(rows.groupBy("uri", "label", "alt_label").agg(F.count(F.lit(1)).alias("n")), "uri")


# ---------------------------------------------------------------- E4 / A2


def property_members(g: DataFrame, uri=None) -> DataFrame:
    return restrict(instances(g, V.PROPERTY), "uri", uri)


def properties(g: DataFrame, uri=None) -> DataFrame:
    """DISTINCT ``(uri, name, domain, domain_label, range, range_label)``.

    The domain (range) pattern and its label share one OPTIONAL, so an
    unlabelled domain is not shown at all; several values multiply.
    """
    uri = request_batch(uri)
    p = property_members(g, uri)
    dom = edges(g, V.DOMAIN, "uri", "domain").join(labels(g, "domain", "domain_label"), "domain", "inner")
    rng = edges(g, V.RANGE, "uri", "range").join(labels(g, "range", "range_label"), "range", "inner")
    rows = (
        p.join(restrict(labels(g, "uri", "name"), "uri", uri), "uri", "left")
        .join(restrict(dom, "uri", uri), "uri", "left")
        .join(restrict(rng, "uri", uri), "uri", "left")
        .select("uri", "name", "domain", "domain_label", "range", "range_label")
        .distinct()
    )
    return full_iris(rows, "uri", "domain", "range")


def properties_alt_labels(g: DataFrame) -> DataFrame:
    """A2: ``(uri, name, alt_label)``, one row per value; a property without any has a NULL one."""
    alts = values(g, V.ALT_LABEL, "uri", "alt_label")
    rows = property_members(g).join(labels(g, "uri", "name"), "uri", "left").join(alts, "uri", "left")
    return full_iris(rows.select("uri", "name", "alt_label"), "uri")


# ---------------------------------------------------------------- E5 - E8


def _type_rank(t: Column) -> Column:
    # "First solution" made deterministic: rdfs:Class, then skos:Concept, then the smallest.
    return F.when(t == V.CLASS, 0).when(t == V.CONCEPT, 1).otherwise(2)


# Predicates of the ontology side, whose partitions hold the subjects page look-ups ask for.
ONTOLOGY_PREDICATES = (V.TYPE, V.LABEL, V.COMMENT, V.SUBCLASS_OF, V.ALT_LABEL, V.BROADER, V.NARROWER,
                       V.DOMAIN, V.RANGE)


def _ontology(g: DataFrame, *preds: str) -> DataFrame:
    """Triples of ``preds`` but the types of catalog objects, which have partitions of their own."""
    if PK in g.columns:
        classes = [c for c in KNOWN_CLASSES if c not in CATALOG_CLASSES]
        g = g.filter(F.col(PK).isin(*storage_keys(preds, classes)))
    return g.filter(F.col("p").isin(*preds) & ~_catalog_type())


def _catalog_type() -> Column:
    return (F.col("p") == V.TYPE) & F.col("o").isin(*CATALOG_CLASSES) & (F.col("o_kind") == IRI)


def _rest(g: DataFrame) -> DataFrame:
    """The triples that :func:`_ontology` of all its predicates leaves out."""
    if PK in g.columns:
        classes = [c for c in KNOWN_CLASSES if c not in CATALOG_CLASSES]
        g = g.filter(~F.col(PK).isin(*[k for k in storage_keys(ONTOLOGY_PREDICATES, classes)]))
    return g.filter(~F.col("p").isin(*ONTOLOGY_PREDICATES) | _catalog_type())


def _present(g: DataFrame, uris: DataFrame | str | Iterable[str]) -> DataFrame:
    """Requested URIs that are the subject of at least one triple.

    Two phases: the ontology partitions answer for most requests; only URIs
    not found there are looked up in the remaining (catalog-sized)
    partitions, and that scan is skipped when none are left.
    """
    req = request_batch(uris)
    if not isinstance(req, DataFrame):
        return request_batch(restrict(g.select(F.col("s").alias("uri")), "uri", req).distinct())
    found = _subjects(_ontology(g, *ONTOLOGY_PREDICATES), req)
    rest = request_batch(req.join(found, "uri", "left_anti"))
    if rest._rows == 0:
        present = found
    else:
        present = found.unionByName(_subjects(_rest(g), rest))
    if req._bounded:
        # A subset of a proven-bounded batch is bounded too: no second check.
        return _prepared(F.broadcast(present))
    return request_batch(present)


def _subjects(g: DataFrame, batch: DataFrame) -> DataFrame:
    """The distinct subjects of ``g`` that a prepared batch holds. A batch that is shuffled meets
    them when they are distinct, so a subject with very many triples is one row of a task."""
    rows = g.select(F.col("s").alias("uri"))
    return restrict(rows, "uri", batch).distinct() if batch._bounded else restrict(rows.distinct(), "uri", batch)


def _prepared(df: DataFrame) -> DataFrame:
    df._prepared_batch = True
    df._bounded = True
    return df


def alt_labels(g: DataFrame, uri=None) -> DataFrame:
    """``(uri, alt_label)``, one row per value, for any resource with alt labels."""
    return full_iris(restrict(values(g, V.ALT_LABEL, "uri", "alt_label"), "uri", request_batch(uri)), "uri")


def _with_alt_count(g: DataFrame, rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` (one per URI of ``base``) with ``n_alt_labels``. A batch that is shuffled meets counts, not the labels."""
    alts = values(g, V.ALT_LABEL, "uri", "alt")
    counts = (restrict(alts, "uri", base) if base._bounded else alts).groupBy("uri").agg(F.count(F.lit(1)).alias("n_alt_labels"))
    return rows.join(counts, "uri", "left").withColumn("n_alt_labels", F.coalesce("n_alt_labels", F.lit(0)))


def concept_detail(g: DataFrame, uris) -> DataFrame:
    """E5: one row per requested URI that exists: ``(uri, label, comment, type, n_alt_labels)``;
    the alt labels themselves are the long rows of :func:`alt_labels`."""
    return detail_of_present(g, present_subjects(g, uris))


def present_subjects(g: DataFrame, uris) -> DataFrame:
    """The prepared batch of requested URIs that are the subject of some triple."""
    return _present(g, uris)


def detail_of_present(g: DataFrame, base: DataFrame) -> DataFrame:
    """E5 for a batch already reduced to existing subjects (see :func:`present_subjects`).

    One pass: the label, comment and type scans of the batch are aggregated
    together per URI with conditional aggregates. Types of catalog objects are
    read only for URIs that have no concept type, which would come first.
    """
    rows = restrict(_ontology(g, V.LABEL, V.COMMENT, V.TYPE)
                    .select(F.col("s").alias("uri"), "p", "o"), "uri", base)

    def of(pred: str, value):
        return F.when(F.col("p") == pred, value)

    def first_type(when: Column):
        return F.min(F.when(when, F.struct(_type_rank(F.col("o")).alias("r"), F.col("o").alias("t"))))

    per = rows.groupBy("uri").agg(
        F.min(of(V.LABEL, F.col("o"))).alias("label"),
        F.min(of(V.COMMENT, F.col("o"))).alias("comment"),
        first_type(F.col("p") == V.TYPE).alias("type"),
    )
    per = base.join(per, "uri", "left")
    open_ = request_batch(per.filter("type is null or type.r = 2").select("uri"))
    if open_._rows != 0:
        catalog = instances(g, V.TABLE).withColumn("o", F.lit(V.TABLE)).unionByName(
            instances(g, V.COLUMN).withColumn("o", F.lit(V.COLUMN)))
        more = restrict(catalog, "uri", open_).groupBy("uri").agg(first_type(F.lit(True)).alias("more"))
        per = per.join(more, "uri", "left").withColumn("type", F.least("type", "more")).drop("more")
    return full_iris(_with_alt_count(g, per.withColumn("type", F.col("type.t")), base), "uri", "type").select(
        "uri", "label", "comment", "type", "n_alt_labels")


def property_detail(g: DataFrame, uris) -> DataFrame:
    """Like E5 for typed properties; domain/range kept even when unlabelled."""
    base = request_batch(property_members(g, request_batch(uris)))
    lab = restrict(labels(g), "uri", base).groupBy("uri").agg(F.min("label").alias("label"))
    com = restrict(values(g, V.COMMENT, "uri", "c"), "uri", base).groupBy("uri").agg(F.min("c").alias("comment"))

    def end(pred: str, name: str) -> DataFrame:
        e = restrict(edges(g, pred, "uri", name), "uri", base).join(
            labels(g, name, f"{name}_label"), name, "left")
        return e.groupBy("uri").agg(F.min(F.struct(name, f"{name}_label")).alias("m")).select(
            "uri", F.col(f"m.{name}").alias(name), F.col(f"m.{name}_label").alias(f"{name}_label"))

    rows = (
        base.join(lab, "uri", "left").join(com, "uri", "left")
        .join(end(V.DOMAIN, "domain"), "uri", "left").join(end(V.RANGE, "range"), "uri", "left")
    )
    return full_iris(_with_alt_count(g, rows, base), "uri", "domain", "range").select(
        "uri", "label", "comment", "domain", "domain_label", "range", "range_label", "n_alt_labels")


def concept_relationships(g: DataFrame, uri=None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """Outgoing hierarchy edges of concepts with the target's label.

    ``(uri, predicate, object, object_label, predicate_type)``; ``predicate`` is
    the full IRI, ``predicate_type`` its compact name. With ``uri=None`` it runs
    for every concept at once instead of one query per concept.
    """
    rel = by_predicate(g, *V.HIERARCHY).select(
        F.col("s").alias("uri"), F.col("p").alias("predicate_type"), F.col("o").alias("object"))
    rel = rel.join(concept_members(g), "uri", "left_semi") if uri is None else restrict(rel, "uri", request_batch(uri))
    return full_iris(rel.join(labels(g, "object", "object_label"), "object", "left"), "uri", "object").select(
        "uri", expand_curie(F.col("predicate_type"), namespaces).alias("predicate"), "object", "object_label",
        "predicate_type",
    )
