"""End-to-end batch jobs on stored inputs."""

import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ontocat.model import TRIPLE_COLUMNS
from ontocat.operators import mutations
from ontocat.plans import jobs
from ontocat.sources import commands, fixtures
from ontocat.sources.store import open_graph, write_graph


def test_sync_import_export_jobs(spark):
    base = tempfile.mkdtemp(prefix="ontocat-jobs-")
    graph_path = write_graph(fixtures.derived_graph(spark, SF_SMALL), f"{base}/graph")
    fixtures.current_tags(spark, SF_SMALL).write.parquet(f"{base}/tags")

    out = jobs.sync_tags(spark, graph_path, f"{base}/tags", f"{base}/sync")
    plan = spark.read.parquet(out["plan"])
    changes = spark.read.parquet(out["changes"])
    assert plan.count() == 2644
    assert changes.count() == plan.filter(~F.col("skipped")).count()
    assert changes.filter((F.col("action") == "delete") != (F.col("step") == 0)).count() == 0

    exported = jobs.export_graph(spark, graph_path, f"{base}/export")["ntriples"]
    imported = jobs.import_graph(spark, None, exported, f"{base}/import")
    back = open_graph(spark, imported["graph"]).select(*TRIPLE_COLUMNS)
    original = open_graph(spark, graph_path).select(*TRIPLE_COLUMNS)
    assert back.subtract(original).count() == 0 and original.subtract(back).count() == 0
    assert spark.read.text(imported["rejects"]).count() == 0


def test_a_graph_that_is_not_there_is_an_error(spark):
    base = tempfile.mkdtemp(prefix="ontocat-jobs-")
    with pytest.raises(AnalysisException):
        open_graph(spark, f"{base}/typo")
    with pytest.raises(AnalysisException):
        jobs.sync_tags(spark, f"{base}/typo", f"{base}/tags", f"{base}/sync", include_unmapped=True)
    spark.createDataFrame([("<a> <b> <c> .",)], "value string").write.text(f"{base}/lines")
    with pytest.raises(AnalysisException):
        jobs.import_graph(spark, f"{base}/typo", f"{base}/lines", f"{base}/out")
    made = jobs.import_graph(spark, f"{base}/typo", f"{base}/lines", f"{base}/out2", create=True)
    assert [tuple(r)[:4] for r in open_graph(spark, made["graph"]).select(*TRIPLE_COLUMNS).collect()] == [("a", "b", "c", "iri")]


def test_apply_writes_only_touched_partitions(spark):
    base = tempfile.mkdtemp(prefix="ontocat-jobs-")
    path = write_graph(fixtures.derived_graph(spark, SF_SMALL), f"{base}/graph")
    commands.relationship_adds(spark, SF_SMALL).write.parquet(f"{base}/adds")
    out = jobs.apply_commands(spark, path, "add-relationships", f"{base}/adds", f"{base}/one")
    want, rejected = mutations.add_relationships(open_graph(spark, path), commands.relationship_adds(spark, SF_SMALL))
    got = open_graph(spark, out["graph"]).select(*TRIPLE_COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spark.read.parquet(out["rejects"]).count() == rejected.count() > 0
    written = {d for d in os.listdir(f"{base}/one/graph/changed") if d.startswith("pk=")}
    assert written == {"pk=rdfs%3AsubClassOf", "pk=skos%3Abroader", "pk=~other"}
    commands.delete_commands(spark, SF_SMALL).write.parquet(f"{base}/deletes")
    two = jobs.apply_commands(spark, out["graph"], "delete-objects", f"{base}/deletes", f"{base}/two")
    want = mutations.delete_objects(got, commands.delete_commands(spark, SF_SMALL))
    back = open_graph(spark, two["graph"])
    assert sorted(map(tuple, back.select(*TRIPLE_COLUMNS).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "pk=uc%3ApropertyAssignment" not in os.listdir(f"{base}/two/graph/changed")


@pytest.mark.parametrize("command", sorted(mutations.CHANGES))
def test_every_command_rejects_incomplete_rows_and_adds_no_null(spark, command):
    columns = {"seq": "bigint", "uri": "string", "name": "string", "label": "string", "type": "string", "comment": "string",
               "domain": "string", "range": "string", "alt_labels": "array<string>", "subject_uri": "string",
               "predicate_type": "string", "object_uri": "string", "entity_uri": "string", "target_uri": "string",
               "catalog": "string", "schema": "string", "table": "string", "column": "string"}
    cmds = spark.createDataFrame([tuple([i] + [None] * (len(columns) - 1)) for i in range(3)],
                                 ", ".join(f"`{k}` {v}" for k, v in columns.items()))
    g = open_graph(spark, None)
    change = mutations.CHANGES[command](g, cmds)
    assert change.rejected.count() == 3 and change.apply(g).count() == 0
