"""The tag mapping (G2) and sync plan (G1) kept up to date from change sets.

The mapping is a bag: assignments joined with names and labels, each of its rows
``(type, name, tag)`` with a count. When a batch changes the graph from old to
new, the bag changes by

    dA * N_new * L_new  +  A_old * dN * L_new  +  A_old * N_old * dL

where ``d`` marks the triples added (weight 1) and removed (weight -1) and a new
relation is the old one plus its change. Every product has the batch in it, so
only assignments, names and labels that meet it are joined; counts add up, so
several names or labels of one object need no special care. The plan is made
again for the entities whose mapping has changed and for no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.model import TRIPLE_COLUMNS, Vocab, by_predicate
from ontocat.operators.joins import broadcast_if_bounded
from ontocat.operators.mutations import triples_not_in
from ontocat.operators.tagsync import DEFAULT_PREFIX, ENTITY, MAX_TAGS, tag_sync_plan
from ontocat.session import new_snapshot_path

V = Vocab
PAIR = ["type", "name", "tag"]
#: What the mapping is made of: type of entity -> predicate of its assignments.
ASSIGNED = {"tables": V.CONCEPT_ASSIGNMENT, "columns": V.PROPERTY_ASSIGNMENT}


def _same(a: DataFrame, b: DataFrame):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in TRIPLE_COLUMNS])


def graph_delta(g: DataFrame, change) -> DataFrame:
    """The triples that ``change`` (a change set, or a log's) adds to ``g`` and removes from it: triple columns and ``w`` (1 or -1).

    A triple that is removed and added again has not changed, nor one that is
    added and there already. Written to the shared folder, as every product of
    :func:`mapping_delta` reads it.
    """
    parts = change._parts() if hasattr(change, "_parts") else [change] if change.removals is not None else []
    put = None if change.additions is None else change.additions.select(*TRIPLE_COLUMNS).distinct()
    out = [] if put is None else [triples_not_in(g, put).select(*TRIPLE_COLUMNS, F.lit(1).alias("w"))]
    gone = [g.join(broadcast_if_bounded(p.removals.select(*p.keys).distinct()), list(p.keys), "left_semi").select(*TRIPLE_COLUMNS) for p in parts]
    if gone:
        gone = reduce(DataFrame.unionByName, gone).distinct()
        if put is not None:
            a, b = gone.alias("gone"), broadcast_if_bounded(put).alias("put")
            gone = a.join(b, _same(a, b), "left_anti")
        out.append(gone.select(*TRIPLE_COLUMNS, F.lit(-1).alias("w")))
    spark = g.sparkSession
    if not out:
        return g.select(*TRIPLE_COLUMNS).limit(0).withColumn("w", F.lit(1))
    path = new_snapshot_path(spark, "graph-delta")
    reduce(DataFrame.unionByName, out).write.parquet(path)
    return spark.read.parquet(path)


def mapping_delta(g: DataFrame, delta: DataFrame) -> DataFrame:
    """``(type, name, tag, n)``: how the counts of the mapping of ``g`` change with ``delta`` (see :func:`graph_delta`); none is 0.

    Written to the shared folder, as mapping and plan are both merged with it.
    """
    def old(pred: str, key: str, value: str, weight: str) -> DataFrame:
        return by_predicate(g, pred).select(F.col("s").alias(key), F.col("o").alias(value), F.lit(1).alias(weight))

    def changed(pred: str, key: str, value: str, weight: str) -> DataFrame:
        return delta.filter(F.col("p") == pred).select(F.col("s").alias(key), F.col("o").alias(value), F.col("w").alias(weight))

    def met(side: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
        """The rows of a large side that a product can use."""
        return side.join(broadcast_if_bounded(wanted.select(key).distinct()), key, "left_semi")

    products = []
    for kind, pred in ASSIGNED.items():
        a_args, n_args, l_args = (pred, "entity", "target", "wa"), (V.NAME, "entity", "name", "wn"), (V.LABEL, "target", "tag", "wl")
        d_a, d_n, d_l = changed(*a_args), changed(*n_args), changed(*l_args)
        n_new, l_new = old(*n_args).unionByName(d_n), old(*l_args).unionByName(d_l)
        named = d_a.join(met(n_new, d_a, "entity"), "entity")
        renamed = met(old(*a_args), d_n, "entity").join(d_n, "entity")
        relabelled = met(old(*a_args), d_l, "target").join(d_l, "target")
        rows = [named.join(met(l_new, named, "target"), "target"), renamed.join(met(l_new, renamed, "target"), "target"),
                relabelled.join(old(*n_args), "entity")]
        products += [r.select(F.lit(kind).alias("type"), "name", "tag", (F.col("wa") * F.col("wn") * F.col("wl")).alias("n")) for r in rows]
    both = reduce(DataFrame.unionByName, products).filter((F.col("name") != "") & (F.col("tag") != ""))
    path = new_snapshot_path(g.sparkSession, "mapping-delta")
    both.groupBy(*PAIR).agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(path)
    return g.sparkSession.read.schema("type string, name string, tag string, n bigint").parquet(path)


def merge_mapping(mapping: DataFrame, delta: DataFrame) -> DataFrame:
    """The mapping ``(type, name, tag, n)`` after a change of counts. Untouched rows pass by a broadcast of the changed keys."""
    keys = broadcast_if_bounded(delta.select(*PAIR))
    touched = mapping.select(*PAIR, "n").join(keys, PAIR, "left_semi").unionByName(delta.select(*PAIR, "n"))
    rest = mapping.select(*PAIR, "n").join(keys, PAIR, "left_anti")
    return rest.unionByName(touched.groupBy(*PAIR).agg(F.sum("n").alias("n")).filter("n > 0"))


def _entities(delta: DataFrame) -> DataFrame:
    return delta.select(F.col("type").alias("entity_type"), F.col("name").alias("entity_name")).distinct()


def changed_plan(mapping: DataFrame, delta: DataFrame, current: DataFrame, prefix: str = DEFAULT_PREFIX, limit: int = MAX_TAGS,
                 include_unmapped: bool = False) -> DataFrame:
    """The sync plan of the entities whose mapping ``delta`` has changed; ``mapping`` is the merged one."""
    entities = broadcast_if_bounded(_entities(delta))
    own = mapping.join(entities, (F.col("type") == F.col("entity_type")) & (F.col("name") == F.col("entity_name")), "left_semi")
    return tag_sync_plan(own, current.join(entities, ENTITY, "left_semi"), prefix, limit, include_unmapped)


def merge_plan(plan: DataFrame, delta: DataFrame, mapping: DataFrame, current: DataFrame, prefix: str = DEFAULT_PREFIX, limit: int = MAX_TAGS,
               include_unmapped: bool = False) -> DataFrame:
    """A sync plan after a change of the mapping: new for the entities it touches, kept for the others."""
    rest = plan.join(broadcast_if_bounded(_entities(delta)), ENTITY, "left_anti")
    return rest.unionByName(changed_plan(mapping, delta, current, prefix, limit, include_unmapped))
