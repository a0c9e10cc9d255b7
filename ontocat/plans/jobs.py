"""Batch jobs: read stored inputs, run the operators, write the outputs.

* ``sync``   stored graph + current tags -> tag mapping -> sync plan -> change table (S1, S5, G2, G1, S7)
* ``apply-tags`` change table -> tags of a folder target, journaled and resumable (S7)
* ``import`` stored graph + N-Triples or Turtle files -> new graph snapshot + rejects (S1, S2)
* ``export`` stored graph -> N-Triples or Turtle text files (S1, S3)
* ``apply``  stored graph + command table -> new graph snapshot + rejects (S1, S4, U1-U11); with ``--log``, the next
  commit of a graph log

Each job writes to new paths only (never over its inputs) and returns the
paths it wrote. A graph path without a graph is an error unless ``--create`` is
given. Snapshots hold the partitions that changed and refer to the others. Run as ``python -m ontocat.plans.jobs <job> ...``.
"""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ontocat.operators import tagsync
from ontocat.operators.command_log import log_changes
from ontocat.operators.mutations import CHANGES, ChangeSet
from ontocat.model import PK
from ontocat.sources import ntriples, turtle, turtle_export
from ontocat.session import bound_tasks
from ontocat.sources.snapshot_log import EVERYTHING, READS, GraphLog
from ontocat.sources.store import open_graph, write_changed
from ontocat.sources.tag_sink import FolderTarget, TagTarget, apply_changes


#: Commands of the ``apply`` job; ``log`` is a table of mixed commands in their order.
COMMANDS = {**CHANGES, "log": log_changes}


def sync_tags(spark: SparkSession, graph_path: str, current_tags_path: str, out_path: str,
              prefix: str = tagsync.DEFAULT_PREFIX, limit: int = tagsync.MAX_TAGS,
              include_unmapped: bool = False) -> dict[str, str]:
    """Write the applicable tag changes (``change_table``) and the full plan with skip flags."""
    g = open_graph(spark, graph_path)
    current = spark.read.parquet(current_tags_path).select("entity_type", "entity_name", "tag_key")
    plan = tagsync.tag_sync_plan(tagsync.tag_mapping_pairs(g), current, prefix=prefix, limit=limit,
                                 include_unmapped=include_unmapped)
    plan_path, changes_path = f"{out_path}/plan", f"{out_path}/changes"
    plan.write.mode("errorifexists").partitionBy("entity_type").parquet(plan_path)
    # Changes are applied from the written plan, not recomputed from the inputs.
    written = spark.read.parquet(plan_path)
    tagsync.change_table(written).write.mode("errorifexists").partitionBy("entity_type", "step").parquet(
        changes_path)
    return {"plan": plan_path, "changes": changes_path}


def apply_tags(spark: SparkSession, changes_path: str, target: TagTarget, journal: str) -> dict[str, str]:
    """Apply a stored change table once; started again with the same journal, it goes on where it was stopped."""
    done = apply_changes(spark.read.parquet(changes_path), target, journal)
    return {"journal": journal, "changes": str(done.agg(F.coalesce(F.sum("changes"), F.lit(0))).first()[0])}


def _apply(spark: SparkSession, graph_path: str | None, change: ChangeSet, out_path: str, create: bool) -> str:
    """The new snapshot: only the partitions that the change set touches are read whole and written."""
    g = open_graph(spark, graph_path, create)
    touched = change.touched(g)
    part = g.filter(F.col(PK).isin(*touched)) if touched else g.filter(F.lit(False))
    old = None if create and not g.take(1) else graph_path
    return write_changed(spark, old, change.apply(part), out_path, touched)


def import_graph(spark: SparkSession, graph_path: str | None, files: str, out_path: str,
                 batch_id: str | None = None, create: bool = False, syntax: str = "ntriples", parts: bool = False) -> dict[str, str]:
    """Merge N-Triples or Turtle files into the graph as a new snapshot; what was rejected goes beside it.

    ``parts``: Turtle files are the parts of one export, whose blank nodes they share."""
    bid = batch_id or uuid.uuid4().hex[:12]
    if syntax == "turtle":
        parsed, rejects = turtle.parse_turtle(turtle.read_turtle(spark, files), bid, parts=parts)
    else:
        parsed, rejects = ntriples.parse_lines(ntriples.read_ntriples(spark, files), bid)
    graph_out, rejects_out = f"{out_path}/graph", f"{out_path}/rejects"
    _apply(spark, graph_path, ChangeSet(parsed), graph_out, create)
    rejects.write.mode("errorifexists").text(rejects_out)
    return {"graph": graph_out, "rejects": rejects_out}


def apply_commands(spark: SparkSession, graph_path: str | None, command: str, commands_path: str, out_path: str,
                   create: bool = False) -> dict[str, str]:
    """Apply a command table (Parquet; columns as its operator says); rejected commands go beside the snapshot."""
    change = COMMANDS[command](open_graph(spark, graph_path, create), spark.read.parquet(commands_path))
    graph_out, rejects_out = f"{out_path}/graph", f"{out_path}/rejects"
    _apply(spark, graph_path, change, graph_out, create)
    change.rejected.write.mode("errorifexists").parquet(rejects_out)
    return {"graph": graph_out, "rejects": rejects_out}


def apply_logged(spark: SparkSession, log_path: str, command: str, commands_path: str) -> dict[str, str]:
    """Apply a command table as the next commit of a graph log, beside other writers; rejects go beside the data."""
    log, plan = GraphLog(spark, log_path), COMMANDS[command]
    cmds = spark.read.parquet(commands_path)
    entry = log.commit(lambda g: plan(g, cmds), READS.get(command, (EVERYTHING,) if command == "log" else ()), note=command)
    rejects_out = f"{log.root}/rejects/{uuid.uuid4().hex}"
    plan(log.open(), cmds).rejected.write.parquet(rejects_out)
    return {"log": log.root, "commit": str(entry.number), "rejects": rejects_out}


def export_graph(spark: SparkSession, graph_path: str, out_path: str, syntax: str = "ntriples") -> dict[str, str]:
    """Write the graph as N-Triples or Turtle text."""
    if syntax == "turtle":
        return {"turtle": turtle_export.export_turtle(open_graph(spark, graph_path), out_path)}
    return {"ntriples": ntriples.export_graph(open_graph(spark, graph_path), out_path)}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="ontocat.plans.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    s = sub.add_parser("sync")
    s.add_argument("--graph", required=True)
    s.add_argument("--current-tags", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--prefix", default=tagsync.DEFAULT_PREFIX)
    s.add_argument("--limit", type=int, default=tagsync.MAX_TAGS)
    s.add_argument("--include-unmapped", action="store_true")
    i = sub.add_parser("import")
    i.add_argument("--graph")
    i.add_argument("--files", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--batch-id")
    i.add_argument("--create", action="store_true")
    i.add_argument("--syntax", choices=["ntriples", "turtle"], default="ntriples")
    i.add_argument("--parts", action="store_true", help="the Turtle files are the parts of one export")
    c = sub.add_parser("apply")
    where = c.add_mutually_exclusive_group(required=True)
    where.add_argument("--graph")
    where.add_argument("--log")
    c.add_argument("--command", required=True, choices=sorted(COMMANDS))
    c.add_argument("--commands", required=True)
    c.add_argument("--out")
    c.add_argument("--create", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("--graph", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--syntax", choices=["ntriples", "turtle"], default="ntriples")
    t = sub.add_parser("apply-tags")
    t.add_argument("--changes", required=True)
    t.add_argument("--tags", required=True, help="folder of the tags (FolderTarget)")
    t.add_argument("--plan", type=int, required=True, help="number of the plan, above those applied to the folder before")
    t.add_argument("--journal", required=True)
    a = ap.parse_args(argv)
    if a.job == "apply" and not (a.log or a.out):
        ap.error("apply --graph needs --out")
    spark = SparkSession.builder.appName(f"ontocat-{a.job}").getOrCreate()
    bound_tasks(spark)
    if a.job == "sync":
        out = sync_tags(spark, a.graph, a.current_tags, a.out, a.prefix, a.limit, a.include_unmapped)
    elif a.job == "import":
        out = import_graph(spark, a.graph, a.files, a.out, a.batch_id, a.create, a.syntax, a.parts)
    elif a.job == "apply" and a.log:
        out = apply_logged(spark, a.log, a.command, a.commands)
    elif a.job == "apply":
        out = apply_commands(spark, a.graph, a.command, a.commands, a.out, a.create)
    elif a.job == "apply-tags":
        out = apply_tags(spark, a.changes, FolderTarget(a.tags, a.plan), a.journal)
    else:
        out = export_graph(spark, a.graph, a.out, a.syntax)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
