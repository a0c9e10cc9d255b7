"""Desired-tag mapping (G2) and the incremental tag-sync plan (G1 with the A6 guard).

The plan is computed on long-form rows ``(entity_type, entity_name, tag_key)``
and never builds a per-entity list, so an entity carrying a large share of
all tags is spread over many tasks: every per-entity quantity is an algebraic
aggregate (partial aggregation before the shuffle), and the only join keyed by
entity alone (changes x per-entity guard) is left to AQE's skew-join split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.operators.assignments import column_assignments, table_assignments

# Defaults of the sync job.
DEFAULT_PREFIX = "TYPE_"
MAX_TAGS = 50

ENTITY = ["entity_type", "entity_name"]


def _truthy(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def tag_mapping_pairs(g: DataFrame) -> DataFrame:
    """G2 long form: ``(type, name, tag)``, one row per assignment (a bag).

    Keeps rows whose object name and target label are both non-empty; the
    mapping is keyed by *name*, so two URIs sharing a name merge.
    """
    t = table_assignments(g).filter(_truthy("table_name") & _truthy("concept_name")).select(
        F.lit("tables").alias("type"), F.col("table_name").alias("name"), F.col("concept_name").alias("tag"))
    c = column_assignments(g).filter(_truthy("column_name") & _truthy("property_name")).select(
        F.lit("columns").alias("type"), F.col("column_name").alias("name"), F.col("property_name").alias("tag"))
    return t.unionByName(c)


def tag_mappings(g: DataFrame) -> DataFrame:
    """``(name, type, tag, n)``: each tag of each catalog object with its multiplicity."""
    return tag_mapping_pairs(g).groupBy("name", "type", "tag").agg(F.count(F.lit(1)).alias("n"))


def mappings_to_json(mapping: DataFrame) -> DataFrame:
    """S6 rows ``{name, type, tags[]}`` for ``write.json``, one tag each, so no entity's list has to fit in a row."""
    return mapping.select("name", "type", F.array("tag").alias("tags"))


MAPPING_JSON_SCHEMA = "name string, type string, tags array<string>"


def mappings_from_json(df: DataFrame) -> DataFrame:
    """A mapping read with ``spark.read.json`` (``{name, type, tags[]}``, any number of rows per entity) in long form."""
    return df.select("type", "name", F.explode("tags").alias("tag"))


def tag_sync_plan(
    mapping: DataFrame,
    current: DataFrame,
    prefix: str = DEFAULT_PREFIX,
    limit: int = MAX_TAGS,
    include_unmapped: bool = False,
) -> DataFrame:
    """G1: tag changes that bring each mapped entity from its current tags to the mapping.

    ``mapping``: long form ``(type, name, tag)`` (see :func:`tag_mapping_pairs`).
    ``current``: ``(entity_type, entity_name, tag_key)``, all tags now on objects.

    Per mapped entity: ``new = {prefix + tag}``, ``old = {current keys starting
    with prefix}``; ``add = new - old``, ``delete = old - new``. A6 guard: when
    ``#current (any prefix) + #add - #delete >= limit`` the entity is skipped,
    adds and deletes alike (rows are kept and flagged ``skipped``). Entities
    absent from the mapping are not visited unless ``include_unmapped``.

    Output ``(entity_type, entity_name, tag_key, action, skipped)``.
    """
    desired = mapping.filter(F.col("tag").isNotNull()).select(
        F.col("type").alias("entity_type"),
        F.col("name").alias("entity_name"),
        F.concat(F.lit(prefix), F.col("tag")).alias("tag_key"),
        F.lit(1).alias("in_new"),
        F.lit(0).alias("in_old"),
    )
    old = current.filter(F.startswith(F.col("tag_key"), F.lit(prefix))).select(
        *ENTITY, "tag_key", F.lit(0).alias("in_new"), F.lit(1).alias("in_old"))

    # One shuffle on (entity, tag) decides membership; duplicates collapse map-side.
    per_tag = desired.unionByName(old).groupBy(*ENTITY, "tag_key").agg(
        F.max("in_new").alias("in_new"), F.max("in_old").alias("in_old"))

    is_add = (F.col("in_new") == 1) & (F.col("in_old") == 0)
    is_del = (F.col("in_new") == 0) & (F.col("in_old") == 1)
    stats = per_tag.groupBy(*ENTITY).agg(
        F.max("in_new").alias("mapped"),
        F.sum(is_add.cast("long")).alias("n_add"),
        F.sum(is_del.cast("long")).alias("n_del"),
    )
    if not include_unmapped:
        stats = stats.filter(F.col("mapped") == 1)
    n_current = current.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n_current"))
    guard = stats.join(n_current, ENTITY, "left").select(
        *ENTITY,
        (F.coalesce(F.col("n_current"), F.lit(0)) + F.col("n_add") - F.col("n_del") >= limit).alias("skipped"),
    )

    changes = per_tag.filter(is_add | is_del).select(
        *ENTITY, "tag_key", F.when(is_add, F.lit("add")).otherwise(F.lit("delete")).alias("action"))
    return changes.join(guard, ENTITY, "inner").select(*ENTITY, "tag_key", "action", "skipped")


def apply_plan(current: DataFrame, plan: DataFrame) -> DataFrame:
    """Current tags after the non-skipped changes of ``plan`` (S7 consumer / checks)."""
    live = plan.filter(~F.col("skipped"))
    kept = current.join(live.filter(F.col("action") == "delete").select(*ENTITY, "tag_key"),
                        [*ENTITY, "tag_key"], "left_anti")
    added = live.filter(F.col("action") == "add").select(*ENTITY, "tag_key")
    return kept.unionByName(added).distinct()


def change_table(plan: DataFrame) -> DataFrame:
    """Applicable changes, ordered delete-before-add per entity (``step`` 0/1)."""
    return plan.filter(~F.col("skipped")).select(
        *ENTITY, "tag_key", "action", F.when(F.col("action") == "delete", 0).otherwise(1).alias("step"))
