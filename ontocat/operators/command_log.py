"""U1-U11 as one ordered log of mixed commands, applied in one pass.

Each command becomes events on triples: it *inserts* a triple, *deletes* one,
*resets* a subject's predicate (an update replaces every value) or *drops* a
subject. An epoch of a triple ends with the last event that removes it; what
the log leaves is

* the triples of the graph that no event removes, and
* the inserted triples whose last insert comes after the last removal of them.

Both follow from the last number of each kind of event per key, whatever the
number of commands: no state is replayed command by command. Only "register
unless it is registered" asks for the state in the middle of the log; for the
subjects it names, the events on their type are put in order, and the last one
before it decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontocat.functions.scalars import expand_curie, mint_iri, store_form
from ontocat.model import IRI, LIT, PK, TRIPLE_COLUMNS, Vocab, instances
from ontocat.operators.joins import broadcast_if_bounded
from ontocat.operators.mutations import CONCEPT_TYPES, ChangeSet, triples_not_in
from ontocat.session import new_snapshot_path

V = Vocab
#: Commands that one task makes events of. A command is short, and its events take long: by its bytes a log of millions is one task's.
TASK_COMMANDS = 50_000
#: Columns of a log; which of them a command reads is said at its kind in :func:`events`.
LOG_FIELDS = {"seq": "bigint", "kind": "string", "uri": "string", "name": "string", "label": "string", "type": "string", "comment": "string",
              "domain": "string", "range": "string", "alt_labels": "array<string>", "predicate_type": "string", "target_uri": "string"}
#: Inside a command: what it asks comes first, then what it removes, then what it adds.
_EVENT = "struct<at:int,op:string,s:string,p:string,o:string,o_kind:string>"


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _event(at: int, op: str, s: Column, p: Column | str | None = None, o: Column | str | None = None, kind: str | None = None) -> Column:
    def text(x):
        return F.lit(x).cast("string") if x is None or isinstance(x, str) else x

    return F.struct(F.lit(at).alias("at"), F.lit(op).alias("op"), s.alias("s"), text(p).alias("p"), text(o).alias("o"), text(kind).alias("o_kind"))


def _some(*cols: Column) -> Column:
    return F.array(*cols).cast(f"array<{_EVENT}>")


def _if(condition: Column, *cols: Column) -> Column:
    return F.when(condition, _some(*cols)).otherwise(_some())


def events(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, rejected)`` of a log: rows ``(seq, at, op, s, p, o, o_kind)``, and the commands that are incomplete.

    Columns that the log lacks count as null. Kinds are those of the ``apply``
    job, with the fields of their command tables; relationships have their
    subject in ``uri`` and their object in ``target_uri``, assignments their
    entity and target. A command of another kind is rejected.
    """
    log = log.select(*[(F.col(c) if c in log.columns else F.lit(None)).cast(t).alias(c) for c, t in LOG_FIELDS.items()])
    c = {name: F.col(name) for name in LOG_FIELDS}
    kind, label, alts = c["kind"], c["label"], F.array_compact(F.coalesce(c["alt_labels"], F.array().cast("array<string>")))
    u = store_form(F.coalesce(F.when(_given(c["uri"]), c["uri"]), F.when(F.startswith(kind, F.lit("register")), mint_iri("name")),
                              F.when(F.startswith(kind, F.lit("insert")), mint_iri("label"))))
    predicate = expand_curie(c["predicate_type"])
    clean = {x: F.when(F.regexp_replace(c[x], r"(?U)^\s+|\s+$", "") != "", F.regexp_replace(c[x], r"(?U)^\s+|\s+$", "")) for x in ("comment", "domain", "range")}
    type_iri = F.create_map(*[x for k, v in CONCEPT_TYPES.items() for x in (F.lit(k), F.lit(v))])[c["type"]]
    has_alts, has_comment = c["alt_labels"].isNotNull(), _given(c["comment"])
    alt_inserts = F.transform(alts, lambda a: _event(2, "insert", u, V.ALT_LABEL, a, LIT)).cast(f"array<{_EVENT}>")
    set_alts = F.when(has_alts, F.concat(_some(_event(1, "reset", u, V.ALT_LABEL)), alt_inserts)).otherwise(_some())

    def replaced(p: str, value: Column, value_kind: str) -> Column:
        return F.concat(_some(_event(1, "reset", u, p)), _if(value.isNotNull(), _event(2, "insert", u, p, value, value_kind)))

    def registered(cls: str) -> Column:
        return _some(_event(0, "name", u, cls, c["name"], LIT), _event(2, "insert", u, V.TYPE, cls, IRI))

    full_uri, target = _given(c["uri"]), store_form(c["target_uri"])
    related = full_uri & _given(c["predicate_type"]) & _given(c["target_uri"]) & predicate.isNotNull()
    assigned = full_uri & _given(c["target_uri"])
    updated = full_uri & label.isNotNull()
    kinds: dict[str, tuple[Column, Column]] = {
        "register-tables": (c["name"].isNotNull(), registered(V.TABLE)),
        "register-columns": (c["name"].isNotNull(), registered(V.COLUMN)),
        "insert-concepts": (label.isNotNull() & c["type"].isin(*CONCEPT_TYPES), F.concat(
            _some(_event(2, "insert", u, V.TYPE, type_iri, IRI), _event(2, "insert", u, V.LABEL, label, LIT)),
            _if(has_comment, _event(2, "insert", u, V.COMMENT, c["comment"], LIT)), alt_inserts)),
        "insert-properties": (label.isNotNull(), F.concat(
            _some(_event(2, "insert", u, V.TYPE, V.PROPERTY, IRI), _event(2, "insert", u, V.LABEL, label, LIT)),
            _if(_given(c["domain"]), _event(2, "insert", u, V.DOMAIN, store_form(c["domain"]), IRI)),
            _if(_given(c["range"]), _event(2, "insert", u, V.RANGE, store_form(c["range"]), IRI)), alt_inserts)),
        "update-concepts": (updated, F.concat(
            replaced(V.LABEL, label, LIT), F.when(has_comment, replaced(V.COMMENT, c["comment"], LIT)).otherwise(_some()), set_alts)),
        "update-properties": (updated, F.concat(
            replaced(V.LABEL, label, LIT), replaced(V.COMMENT, clean["comment"], LIT),
            replaced(V.DOMAIN, store_form(clean["domain"]), IRI), replaced(V.RANGE, store_form(clean["range"]), IRI), set_alts)),
        "add-relationships": (related, _some(_event(2, "insert", u, store_form(predicate), target, IRI))),
        "delete-relationships": (related, _some(_event(1, "delete", u, store_form(predicate), target, IRI))),
        "assign-concepts": (assigned, _some(_event(2, "insert", u, V.CONCEPT_ASSIGNMENT, target, IRI))),
        "assign-properties": (assigned, _some(_event(2, "insert", u, V.PROPERTY_ASSIGNMENT, target, IRI))),
        "delete-objects": (full_uri, _some(_event(1, "drop", u))),
    }
    complete = F.coalesce(reduce(lambda a, b: a | b, [(kind == k) & ok for k, (ok, _) in kinds.items()]), F.lit(False)) & c["seq"].isNotNull()
    made = None
    for k, (_, rows) in kinds.items():
        made = F.when(kind == k, rows) if made is None else made.when(kind == k, rows)
    return log.filter(complete).select("seq", F.inline(made)), log.filter(~complete)


def _names(g: DataFrame, ev: DataFrame) -> DataFrame:
    """The names that registrations add: those whose subject has not the type just before."""
    asked = ev.filter("op = 'name'").select("seq", "at", "s", F.col("p").alias("cls"), F.col("o").alias("name"))
    held = instances(g, V.TABLE, "s").select("s", F.lit(V.TABLE).alias("cls")).unionByName(
        instances(g, V.COLUMN, "s").select("s", F.lit(V.COLUMN).alias("cls")))
    subjects = broadcast_if_bounded(asked.select("s", "cls").distinct())
    held = held.join(subjects, ["s", "cls"], "left_semi").select("s", "cls", F.lit(None).cast("bigint").alias("seq"), F.lit(0).alias("at"), F.lit(True).alias("there"))
    typed = ev.filter((F.col("p") == V.TYPE) & F.col("o").isin(V.TABLE, V.COLUMN) & (F.col("o_kind") == IRI) & F.col("op").isin("insert", "delete")).select(
        "s", F.col("o").alias("cls"), "seq", "at", (F.col("op") == "insert").alias("there"))
    dropped = ev.filter("op = 'drop'").select("s", F.explode(F.array(F.lit(V.TABLE), F.lit(V.COLUMN))).alias("cls"), "seq", "at", F.lit(False).alias("there"))
    told = held.unionByName(typed).unionByName(dropped).withColumn("name", F.lit(None).cast("string"))
    asks = asked.select("s", "cls", "seq", "at", F.lit(None).cast("boolean").alias("there"), "name")
    before = Window.partitionBy("s", "cls").orderBy(F.col("seq").asc_nulls_first(), "at", "name").rowsBetween(Window.unboundedPreceding, -1)
    known = told.join(subjects, ["s", "cls"], "left_semi").unionByName(asks).withColumn("before", F.last("there", ignorenulls=True).over(before))
    return known.filter(F.col("name").isNotNull() & ~F.coalesce("before", F.lit(False))).select("seq", "s", F.lit(V.NAME).alias("p"), F.col("name").alias("o"),
                                                                                               F.lit(LIT).alias("o_kind"))


@dataclass
class LogChange:
    """What a log does to a graph: triples to add, and the removed keys of three kinds."""

    additions: DataFrame
    resets: DataFrame
    drops: DataFrame
    deletes: DataFrame
    rejected: DataFrame

    def _parts(self) -> list[ChangeSet]:
        return [ChangeSet(removals=self.resets, keys=("s", "p")), ChangeSet(removals=self.drops, keys=("s",)),
                ChangeSet(removals=self.deletes, keys=("s", "p", "o", "o_kind"))]

    def touched(self, g: DataFrame) -> list[str]:
        """Storage partitions of ``g`` whose content may change."""
        return sorted({k for part in (ChangeSet(self.additions), *self._parts()) for k in part.touched(g)})

    def apply(self, g: DataFrame) -> DataFrame:
        """The graph after the log: one pass over ``g`` past the removed keys, then the additions it lacks."""
        keep = [*TRIPLE_COLUMNS, PK] if PK in g.columns else list(TRIPLE_COLUMNS)
        out = g.select(*keep)
        for part in self._parts():
            out = out.join(broadcast_if_bounded(part.removals.select(*part.keys)), list(part.keys), "left_anti")
        return out.select(*TRIPLE_COLUMNS).unionByName(triples_not_in(out, self.additions))


def log_changes(g: DataFrame, log: DataFrame) -> LogChange:
    """The change that a log of mixed commands (columns :data:`LOG_FIELDS`) makes to ``g``.

    Equal to applying the commands one by one in the order of ``seq``; of
    commands with equal ``seq`` the removals come first. Events are written to
    the shared folder once; then the last event of each key is an aggregate that
    tasks begin on their side of the shuffle, so a key that a third of all
    commands name is no burden. (A subject registered or dropped that often has
    its type events sorted in one task.) Null, empty or unknown fields reject a
    command; a log without commands changes nothing.
    """
    spark = g.sparkSession
    rejected = events(log)[1]
    made, _ = events(log.repartition(max(1, math.ceil(log.count() / TASK_COMMANDS))))
    path = new_snapshot_path(spark, "command-events")
    made.write.parquet(path)
    ev = spark.read.schema(made.schema).parquet(path)
    inserts = ev.filter("op = 'insert'").select("seq", "s", "p", "o", "o_kind").unionByName(_names(g, ev))
    last = inserts.groupBy("s", "p", "o", "o_kind").agg(F.max("seq").alias("inserted"))
    resets = ev.filter("op = 'reset'").groupBy("s", "p").agg(F.max("seq").alias("reset"))
    drops = ev.filter("op = 'drop'").groupBy("s").agg(F.max("seq").alias("dropped"))
    deletes = ev.filter("op = 'delete'").groupBy("s", "p", "o", "o_kind").agg(F.max("seq").alias("deleted"))
    left = (last.join(resets, ["s", "p"], "left").join(drops, "s", "left").join(deletes, ["s", "p", "o", "o_kind"], "left")
            .filter(F.col("inserted") >= F.coalesce(F.greatest("reset", "dropped", "deleted"), F.col("inserted"))))
    additions = left.select("s", "p", "o", "o_kind", F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    path = new_snapshot_path(spark, "command-additions")
    additions.write.parquet(path)
    return LogChange(spark.read.schema(additions.schema).parquet(path), resets.select("s", "p"), drops.select("s"),
                     deletes.select("s", "p", "o", "o_kind"), rejected)


def apply_log(g: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new_graph, rejected_commands)``."""
    change = log_changes(g, log)
    return change.apply(g), change.rejected
