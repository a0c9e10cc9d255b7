"""The kept mapping and plan equal those made anew after every batch of a random log."""

import random

import pytest

from conftest import make_graph
from ontocat.model import Vocab as V
from ontocat.operators import tagdelta as D
from ontocat.operators.command_log import LOG_FIELDS, log_changes
from ontocat.operators.mutations import ChangeSet
from ontocat.operators.tagsync import tag_mappings, tag_sync_plan
from ontocat.sources.snapshot_log import EVERYTHING, GraphLog

SCHEMA = ", ".join(f"{k} {t}" for k, t in LOG_FIELDS.items())
BASE = [(f"t/{i}", V.TYPE, V.TABLE) for i in range(4)] + [(f"t/{i}", V.NAME, f"n{i % 3}", "lit") for i in range(4)]
BASE += [("c/1", V.LABEL, "one", "lit"), ("c/1", V.LABEL, "uno", "lit"), ("c/2", V.LABEL, "", "lit"), ("t/0", V.CONCEPT_ASSIGNMENT, "c/1"),
         ("t/1", V.CONCEPT_ASSIGNMENT, "c/2"), ("t/2", V.PROPERTY_ASSIGNMENT, "c/1"), ("t/0", V.NAME, "second", "lit")]


def batch(rng, start):
    rows = []
    for i in range(rng.randrange(1, 12)):
        kind = rng.choice(["register-tables", "assign-concepts", "assign-properties", "update-concepts", "insert-concepts", "delete-objects", "add-relationships"])
        uri = rng.choice(["t/0", "t/1", "t/2", "t/3", "t/4"] if kind[0] == "r" or kind.startswith("assign") else ["t/0", "t/4", "c/1", "c/2", "c/3"])
        rows.append((start + i, kind, uri, rng.choice(["n0", "n1", "new"]), rng.choice(["one", "two", "", "three"]), "rdfs_class", None, None, None, None,
                     "uc:conceptAssignment", rng.choice(["c/1", "c/2", "c/3"])))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [4])
def test_every_batch_of_a_random_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = GraphLog(spark, str(tmp_path / "log"))
    log.start(make_graph(spark, BASE))
    current = spark.createDataFrame([("tables", "n0", "TYPE_one"), ("tables", "n1", "TYPE_old"), ("columns", "n2", "other")] + [("tables", "n2", f"k{i}") for i in range(49)],
                                    "entity_type string, entity_name string, tag_key string")
    mapping = tag_mappings(log.open()).select(*D.PAIR, "n")
    plan = tag_sync_plan(mapping, current)
    for n in range(2):
        old = log.open()
        rows = batch(rng, n * 100)
        change = log_changes(old, spark.createDataFrame(rows, SCHEMA))
        delta = D.mapping_delta(old, D.graph_delta(old, change))
        log.commit(lambda g: change, (EVERYTHING,))
        mapping = D.merge_mapping(mapping, delta)
        plan = D.merge_plan(plan, delta, mapping, current)
        mapping = spark.createDataFrame(mapping.collect(), mapping.schema)
        plan = spark.createDataFrame(plan.collect(), plan.schema)
        new = log.open()
        assert rows_of(mapping.select("name", "type", "tag", "n")) == rows_of(tag_mappings(new).select("name", "type", "tag", "n"))
        assert rows_of(plan) == rows_of(tag_sync_plan(tag_mappings(new), current))


def test_only_what_changes_is_in_the_delta(spark):
    g = make_graph(spark, BASE)
    same = ChangeSet(make_graph(spark, [("t/0", V.NAME, "n0", "lit")]), spark.createDataFrame([("t/0", V.NAME)], "s string, p string"))
    delta = D.graph_delta(g, same)
    assert [tuple(r)[:3] + (r.w,) for r in delta.collect()] == [("t/0", V.NAME, "second", -1)]
    assert rows_of(D.mapping_delta(g, delta)) == [("tables", "second", "one", -1), ("tables", "second", "uno", -1)]
    nothing = D.graph_delta(g, ChangeSet())
    assert nothing.count() == 0 and D.mapping_delta(g, nothing).count() == 0
