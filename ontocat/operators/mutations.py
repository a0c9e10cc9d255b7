"""Batch mutations (U1-U11) and catalog registration.

Each reference call changes a few triples; here a *command table* is applied
in one job. Every operator plans a :class:`ChangeSet`: the triples to add, the
keys to remove and the commands rejected as incomplete. Applied to a graph,

    new = (g  minus  removed (s, p[, o]) keys)  union  (additions not already in g)

which keeps set semantics without re-deduplicating the whole graph. Removal
keys and additions are broadcast when their rows and bytes are under a checked
bound, so the graph side is streamed once and never shuffled; larger batches
fall back to shuffle joins. On a stored graph only the partitions that a change
set touches are written (``ontocat.plans.jobs apply``).

IRIs of commands may be full or compact; they are stored in one form. Commands
carry ``seq``. A URI appearing several times in one batch gets the semantics of
sequential calls: inserts accumulate, the first registration of a table/column
wins, updates resolve field by field to the last command that sets the field.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontocat.functions.scalars import expand_curie, mint_iri, qualified_name, store_form
from ontocat.model import (IRI, KNOWN_PREDICATES, LIT, OTHER_PARTITION, PK, TRIPLE_COLUMNS, Vocab, instances, storage_key,
                           storage_keys, triples)
from ontocat.operators.joins import broadcast_if_bounded

V = Vocab

# Concept type choices accepted by concept inserts.
CONCEPT_TYPES = {"rdfs_class": V.CLASS, "skos_concept": V.CONCEPT}


@dataclass
class ChangeSet:
    """Additions (triples), removals (rows of ``keys``) and the rejected commands."""

    additions: DataFrame | None = None
    removals: DataFrame | None = None
    keys: tuple[str, ...] = ("s", "p")
    rejected: DataFrame | None = None

    def apply(self, g: DataFrame) -> DataFrame:
        return apply_changes(g, self.additions, self.removals, self.keys)

    def touched(self, g: DataFrame) -> list[str]:
        """Storage partitions of ``g`` whose content may change (of some 40 there are)."""
        found = []
        if self.additions is not None:
            found.append(self.additions.select(storage_key(F.col("p"), F.col("o"), F.col("o_kind")).alias(PK)))
        if self.removals is not None and "p" not in self.keys:
            found.append(g.join(self.removals.select(*self.keys).distinct(), list(self.keys), "left_semi").select(PK))
        keys = {r[0] for f in found for r in f.distinct().collect()}
        if self.removals is not None and "p" in self.keys:
            known = self.removals.select(F.when(F.col("p").isin(*KNOWN_PREDICATES), F.col("p")).alias("p")).distinct()
            keys |= set(storage_keys([r["p"] or OTHER_PARTITION for r in known.collect()]))
        return sorted(keys)


def apply_changes(g: DataFrame, additions: DataFrame | None = None,
                  removals: DataFrame | None = None, removal_keys: tuple[str, ...] = ("s", "p")) -> DataFrame:
    """``(g minus removals) union (additions minus g)`` with set semantics.

    ``removals`` holds the key columns ``removal_keys`` of the triples to drop
    (e.g. ``(s, p)`` drops every value of a predicate, ``(s,)`` a whole subject).
    The presence test for additions runs after the removals, so a triple that
    is removed and added again survives. Additions with a NULL term are dropped.
    """
    keep = [*TRIPLE_COLUMNS, PK] if PK in g.columns else list(TRIPLE_COLUMNS)
    out = g.select(*keep)
    if removals is not None:
        keys = list(removal_keys)
        out = out.join(broadcast_if_bounded(removals.select(*keys).distinct()), keys, "left_anti")
    if additions is not None:
        out = out.select(*TRIPLE_COLUMNS).unionByName(triples_not_in(out, additions))
    return out.select(*TRIPLE_COLUMNS)


def triples_not_in(g: DataFrame, additions: DataFrame) -> DataFrame:
    """The distinct triples of ``additions`` (without NULL terms) that ``g`` does not hold.

    For a bounded batch the few triples of ``g`` that equal one of the batch are
    found by streaming the partitions it touches past the broadcast batch;
    beyond the bound one shuffled anti-join decides.
    """
    adds = additions.select(*TRIPLE_COLUMNS).filter("s is not null and p is not null and o is not null").distinct()
    small = broadcast_if_bounded(adds)
    if not small._bounded:
        return _anti(adds, g.select(*TRIPLE_COLUMNS))
    if PK in g.columns:
        touched = ChangeSet(additions=adds).touched(g)
        g = g.filter(F.col(PK).isin(*touched)) if touched else g.filter(F.lit(False))
    held = g.select(*TRIPLE_COLUMNS)
    a, b = held.alias("g"), small.alias("a")
    return _anti(adds, a.join(b, _same(a, b), "left_semi"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in TRIPLE_COLUMNS])


def _anti(adds: DataFrame, held: DataFrame) -> DataFrame:
    a, b = adds.alias("a"), held.alias("g")
    return a.join(b, _same(a, b), "left_anti")


def _stripped_or_null(c: Column) -> Column:
    """``value.strip() or None``: surrounding whitespace removed, blank becomes NULL."""
    stripped = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(stripped == "", None).otherwise(stripped)


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _last(value: Column, when: Column | None = None, seq: str = "seq") -> Column:
    """Aggregate: value of the row with the highest ``seq`` (among rows where ``when``)."""
    st = F.struct(F.col(seq).alias("seq"), value.alias("v"))
    return F.max(st if when is None else F.when(when, st))["v"]


def _split(cmds: DataFrame, complete: Column) -> tuple[DataFrame, DataFrame]:
    """The complete commands and the rejected ones."""
    complete = F.coalesce(complete, F.lit(False))
    return cmds.filter(complete), cmds.filter(~complete)


def _minted(uri: str, name: str) -> Column:
    """The command's IRI in stored form, or one minted from a name (P1) when it is missing."""
    return store_form(F.coalesce(F.when(_nonempty(F.col(uri)), F.col(uri)), mint_iri(F.col(name))))


# --------------------------------------------------------------- U1, U2, S4


def _registrations(g: DataFrame, cmds: DataFrame, cls: str) -> ChangeSet:
    """Insert-if-absent: the first command per URI wins; URIs already of ``cls`` are skipped.
    A command without a name is rejected."""
    ok, rejected = _split(cmds, F.col("name").isNotNull())
    first = (ok.select("seq", _minted("uri", "name").alias("uri"), "name")
             .groupBy("uri").agg(F.min(F.struct("seq", "name"))["name"].alias("name")))
    fresh = first.join(instances(g, cls), "uri", "left_anti")
    adds = fresh.select(F.explode(F.array(
        F.struct(*triples(F.col("uri"), V.TYPE, F.lit(cls), IRI)),
        F.struct(*triples(F.col("uri"), V.NAME, F.col("name"), LIT)),
    )).alias("t")).select("t.*")
    return ChangeSet(adds, rejected=rejected)


def table_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    return _registrations(g, cmds, V.TABLE)


def column_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    return _registrations(g, cmds, V.COLUMN)


def upsert_tables(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """``cmds(seq, uri, name)``; an empty URI is minted from the name."""
    return table_changes(g, cmds).apply(g)


def upsert_columns(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """Like U1 for columns."""
    return column_changes(g, cmds).apply(g)


def inventory_changes(g: DataFrame, inventory: DataFrame) -> ChangeSet:
    """``inventory(catalog, schema, table, column)`` -> names (P2) -> IRIs (P1) -> U1/U2.

    A row with a NULL column registers the table; other rows register the
    column. Table registration adds no column types, so both sets of
    additions are computed against ``g`` and applied in one rewrite. A row
    without catalog, schema or table is rejected.
    """
    # A minted URI comes from exactly one name (percent-quoting is injective),
    # so every command for a URI carries the same name and order is irrelevant.
    ok, rejected = _split(inventory, _nonempty(F.col("catalog")) & _nonempty(F.col("schema")) & _nonempty(F.col("table")))
    inv = ok.select("catalog", "schema", "table", "column", F.lit(0).cast("bigint").alias("seq"),
                    F.lit(None).cast("string").alias("uri"))
    tables = inv.select("seq", "uri", qualified_name("catalog", "schema", "table").alias("name"))
    cols = inv.filter(F.col("column").isNotNull()).select(
        "seq", "uri", qualified_name("catalog", "schema", "table", "column").alias("name"))
    return ChangeSet(table_changes(g, tables).additions.unionByName(column_changes(g, cols).additions), rejected=rejected)


def register_inventory(g: DataFrame, inventory: DataFrame) -> DataFrame:
    """S4 applied (see :func:`inventory_changes`)."""
    return inventory_changes(g, inventory).apply(g)


# ---------------------------------------------------------------- U3, U4


def concept_insert_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    """``cmds(seq, uri, label, type, comment, alt_labels)``.

    Adds type, label, comment (when non-empty) and each alt label; repeated
    inserts accumulate. A command without a label or with a type other than
    ``rdfs_class`` / ``skos_concept`` is rejected.
    """
    ok, rejected = _split(cmds, F.col("label").isNotNull() & F.col("type").isin(*CONCEPT_TYPES))
    type_iri = F.create_map(*[x for k, v in CONCEPT_TYPES.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    c = ok.withColumn("type_iri", type_iri).withColumn("uri", _minted("uri", "label"))
    u = F.col("uri")
    adds = c.select(F.inline(F.concat(
        F.array(F.struct(*triples(u, V.TYPE, F.col("type_iri"), IRI)),
                F.struct(*triples(u, V.LABEL, F.col("label"), LIT))),
        F.when(_nonempty(F.col("comment")), F.array(F.struct(*triples(u, V.COMMENT, F.col("comment"), LIT))))
        .otherwise(F.array()),
        _alt_triples(u, F.col("alt_labels")),
    )))
    return ChangeSet(adds, rejected=rejected)


def insert_concepts(g: DataFrame, cmds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U3 applied: ``(new_graph, rejected_commands)``."""
    change = concept_insert_changes(g, cmds)
    return change.apply(g), change.rejected


def property_insert_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    """U4: ``cmds(seq, uri, label, domain, range, alt_labels)``: type, label, domain and
    range when non-empty, each alt label; an empty URI is minted from the label. A
    command without a label is rejected."""
    ok, rejected = _split(cmds, F.col("label").isNotNull())
    c = ok.withColumn("uri", _minted("uri", "label"))
    u = F.col("uri")

    def opt(col: str, pred: str) -> Column:
        return F.when(_nonempty(F.col(col)), F.array(F.struct(*triples(u, pred, store_form(F.col(col)), IRI)))).otherwise(
            F.array())

    adds = c.select(F.inline(F.concat(
        F.array(F.struct(*triples(u, V.TYPE, F.lit(V.PROPERTY), IRI)),
                F.struct(*triples(u, V.LABEL, F.col("label"), LIT))),
        opt("domain", V.DOMAIN),
        opt("range", V.RANGE),
        _alt_triples(u, F.col("alt_labels")),
    )))
    return ChangeSet(adds, rejected=rejected)


def insert_properties(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """U4 applied (see :func:`property_insert_changes`)."""
    return property_insert_changes(g, cmds).apply(g)


# ---------------------------------------------------------------- U5, U6


def _alt_triples(u: Column, alts: Column) -> Column:
    return F.transform(F.array_compact(F.coalesce(alts, F.array().cast("array<string>"))),
                       lambda a: F.struct(*triples(u, V.ALT_LABEL, a, LIT)))


def _updates(cmds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates with a URI (in stored form) and a label; the others are rejected."""
    ok, rejected = _split(cmds, _nonempty(F.col("uri")) & F.col("label").isNotNull())
    return ok.withColumn("uri", store_form(F.col("uri"))), rejected


def concept_update_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    """``cmds(seq, uri, label, comment, alt_labels)``.

    The label is replaced; the comment only by a non-empty one (it cannot be
    cleared); alt labels: NULL keeps them, a list (even empty) replaces all. A
    command without a URI or label is rejected.
    """
    ok, rejected = _updates(cmds)
    per = ok.groupBy("uri").agg(
        _last(F.col("label")).alias("label"),
        _last(F.col("comment"), when=_nonempty(F.col("comment"))).alias("comment"),
        _last(F.col("alt_labels"), when=F.col("alt_labels").isNotNull()).alias("alt_labels"),
        F.max(F.col("alt_labels").isNotNull()).alias("set_alts"),
    )
    u = F.col("uri")
    removals = per.select(F.inline(F.concat(
        F.array(F.struct(u.alias("s"), F.lit(V.LABEL).alias("p"))),
        F.when(F.col("comment").isNotNull(), F.array(F.struct(u.alias("s"), F.lit(V.COMMENT).alias("p"))))
        .otherwise(F.array()),
        F.when(F.col("set_alts"), F.array(F.struct(u.alias("s"), F.lit(V.ALT_LABEL).alias("p"))))
        .otherwise(F.array()),
    )))
    adds = per.select(F.inline(F.concat(
        F.array(F.struct(*triples(u, V.LABEL, F.col("label"), LIT))),
        F.when(F.col("comment").isNotNull(), F.array(F.struct(*triples(u, V.COMMENT, F.col("comment"), LIT))))
        .otherwise(F.array()),
        _alt_triples(u, F.col("alt_labels")),
    )))
    return ChangeSet(adds, removals, rejected=rejected)


def update_concepts(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """U5 applied (see :func:`concept_update_changes`)."""
    return concept_update_changes(g, cmds).apply(g)


def property_update_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    """``cmds(seq, uri, label, comment, domain, range, alt_labels)``.

    Label, comment, domain and range are always replaced by the last command
    (values are stripped of surrounding whitespace, and a blank or NULL value
    clears the field; the label is kept as given); alt labels as U5. A command
    without a URI or label is rejected.
    """
    ok, rejected = _updates(cmds)
    c = ok.select("seq", "uri", "label", "alt_labels",
                    _stripped_or_null(F.col("comment")).alias("comment"),
                    *[store_form(_stripped_or_null(F.col(x))).alias(x) for x in ("domain", "range")])
    per = c.groupBy("uri").agg(
        _last(F.col("label")).alias("label"),
        _last(F.col("comment")).alias("comment"),
        _last(F.col("domain")).alias("domain"),
        _last(F.col("range")).alias("range"),
        _last(F.col("alt_labels"), when=F.col("alt_labels").isNotNull()).alias("alt_labels"),
        F.max(F.col("alt_labels").isNotNull()).alias("set_alts"),
    )
    u = F.col("uri")
    removals = per.select(F.inline(F.concat(
        F.array(*[F.struct(u.alias("s"), F.lit(p).alias("p")) for p in (V.LABEL, V.COMMENT, V.DOMAIN, V.RANGE)]),
        F.when(F.col("set_alts"), F.array(F.struct(u.alias("s"), F.lit(V.ALT_LABEL).alias("p"))))
        .otherwise(F.array()),
    )))

    def opt(col: str, pred: str, kind: str) -> Column:
        return F.when(F.col(col).isNotNull(), F.array(F.struct(*triples(u, pred, F.col(col), kind)))).otherwise(
            F.array())

    adds = per.select(F.inline(F.concat(
        F.array(F.struct(*triples(u, V.LABEL, F.col("label"), LIT))),
        opt("comment", V.COMMENT, LIT), opt("domain", V.DOMAIN, IRI), opt("range", V.RANGE, IRI),
        _alt_triples(u, F.col("alt_labels")),
    )))
    return ChangeSet(adds, removals, rejected=rejected)


def update_properties(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """U6 applied (see :func:`property_update_changes`)."""
    return property_update_changes(g, cmds).apply(g)


# ---------------------------------------------------------------- U7, U8


def resolve_relationships(cmds: DataFrame, namespaces: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """P5 on ``cmds(seq, subject_uri, predicate_type, object_uri)``.

    Returns ``(resolved(s, p, o), rejected)``; a command is rejected when a
    field is missing or empty, or the predicate's prefix is not bound.
    """
    full = expand_curie(F.col("predicate_type"), namespaces)
    complete = _nonempty(F.col("subject_uri")) & _nonempty(F.col("predicate_type")) & _nonempty(F.col("object_uri"))
    good, rejected = _split(cmds, complete & full.isNotNull())
    resolved = good.select(store_form(F.col("subject_uri"), namespaces).alias("s"), store_form(full, namespaces).alias("p"),
                           store_form(F.col("object_uri"), namespaces).alias("o"))
    return resolved, rejected


def relationship_add_changes(g: DataFrame, cmds: DataFrame, namespaces: dict[str, str] | None = None) -> ChangeSet:
    """Set-insert ``(subject, CURIE, object)`` with an IRI object."""
    rel, rejected = resolve_relationships(cmds, namespaces)
    return ChangeSet(rel.select(*triples(F.col("s"), F.col("p"), F.col("o"), IRI)), rejected=rejected)


def add_relationships(g: DataFrame, cmds: DataFrame, namespaces: dict[str, str] | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """U7 applied: ``(new_graph, rejected_commands)``."""
    change = relationship_add_changes(g, cmds, namespaces)
    return change.apply(g), change.rejected


def relationship_delete_changes(g: DataFrame, cmds: DataFrame, namespaces: dict[str, str] | None = None) -> ChangeSet:
    """U8: remove the exact IRI triple; an absent triple is a no-op, an incomplete command is rejected."""
    rel, rejected = resolve_relationships(cmds, namespaces)
    return ChangeSet(removals=rel.withColumn("o_kind", F.lit(IRI)), keys=("s", "p", "o", "o_kind"), rejected=rejected)


def delete_relationships(g: DataFrame, cmds: DataFrame, namespaces: dict[str, str] | None = None) -> DataFrame:
    """U8 applied (see :func:`relationship_delete_changes`)."""
    return relationship_delete_changes(g, cmds, namespaces).apply(g)


# ---------------------------------------------------------------- U9 - U11


def _assignments(cmds: DataFrame, pred: str) -> ChangeSet:
    ok, rejected = _split(cmds, _nonempty(F.col("entity_uri")) & _nonempty(F.col("target_uri")))
    return ChangeSet(ok.select(*triples(store_form(F.col("entity_uri")), pred, store_form(F.col("target_uri")), IRI)),
                     rejected=rejected)


def concept_assignment_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    return _assignments(cmds, V.CONCEPT_ASSIGNMENT)


def property_assignment_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    return _assignments(cmds, V.PROPERTY_ASSIGNMENT)


def assign_concepts(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """``cmds(seq, entity_uri, target_uri)`` table -> concept; no existence check."""
    return concept_assignment_changes(g, cmds).apply(g)


def assign_properties(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """Column -> property."""
    return property_assignment_changes(g, cmds).apply(g)


def delete_changes(g: DataFrame, cmds: DataFrame) -> ChangeSet:
    """``cmds(seq, uri)``: drop every triple whose *subject* is the URI.

    References to it from other subjects stay (dangling). A command without a
    URI is rejected."""
    ok, rejected = _split(cmds, _nonempty(F.col("uri")))
    return ChangeSet(removals=ok.select(store_form(F.col("uri")).alias("s")), keys=("s",), rejected=rejected)


def delete_objects(g: DataFrame, cmds: DataFrame) -> DataFrame:
    """U11 applied (see :func:`delete_changes`)."""
    return delete_changes(g, cmds).apply(g)


#: Command name of the ``apply`` job -> planner of its change set.
CHANGES = {
    "register-tables": table_changes, "register-columns": column_changes, "register-inventory": inventory_changes,
    "insert-concepts": concept_insert_changes, "insert-properties": property_insert_changes,
    "update-concepts": concept_update_changes, "update-properties": property_update_changes,
    "add-relationships": relationship_add_changes, "delete-relationships": relationship_delete_changes,
    "assign-concepts": concept_assignment_changes, "assign-properties": property_assignment_changes,
    "delete-objects": delete_changes,
}
