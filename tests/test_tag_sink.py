"""Tag changes applied once and in order, through failures between and inside the steps."""

import os
from collections import Counter

import pytest

from ontocat.operators import tagsync
from ontocat.sources import tag_sink
from ontocat.sources.tag_sink import ADD, DELETE, FolderTarget, apply_changes, journal_chunks

SCHEMA = "entity_type string, entity_name string, tag_key string, step int"


def files_target(root, dies_at):
    """A catalog with a file per tag and a log of what was done; it dies for good at the n-th change that starts with ``dies_at``."""

    class Files:
        def _path(self, change):
            return os.path.join(root, "__".join(change))

        def missing(self, chunk, step, changes):
            return [c for c in changes if os.path.exists(self._path(c)) == (step == 0)]

        def apply(self, chunk, step, changes):
            for c in changes:
                if dies_at and c[2] == dies_at:
                    raise RuntimeError("executor lost")
                os.remove(self._path(c)) if step == 0 else open(self._path(c), "x").close()
                with open(root + ".log", "a") as log:
                    log.write(f"{step} {'__'.join(c)}\n")

    return Files()


@pytest.fixture
def changes(spark):
    rows = [("tables", f"t{i % 7}", f"old{i}", DELETE) for i in range(60)] + [("tables", f"t{i % 7}", f"new{i}", ADD) for i in range(90)]
    return spark.createDataFrame(rows + rows[:5] + [("tables", None, "x", ADD)], SCHEMA)


@pytest.mark.parametrize("dies_at", ["old33", "new0", "new71", None])
def test_stopped_anywhere_and_started_again(spark, changes, tmp_path, monkeypatch, dies_at):
    monkeypatch.setattr(tag_sink, "CHUNK_ROWS", 10)
    root, journal = str(tmp_path / "catalog"), str(tmp_path / "journal")
    os.mkdir(root)
    for i in range(60):
        open(os.path.join(root, f"tables__t{i % 7}__old{i}"), "x").close()
    if dies_at:
        with pytest.raises(Exception, match="executor lost"):
            apply_changes(changes, files_target(root, dies_at), journal)
        if dies_at.startswith("old"):
            assert not [f for f in os.listdir(root) if "new" in f]  # no add before the last delete
    done = apply_changes(changes, files_target(root, None), journal)
    assert sorted(os.listdir(root)) == sorted(f"tables__t{i % 7}__new{i}" for i in range(90))
    log = open(root + ".log").read().split("\n")[:-1]
    assert len(log) == 150 and max(Counter(log).values()) == 1
    assert [line[0] for line in log] == ["0"] * 60 + ["1"] * 90
    assert {r.step: r.n for r in done.groupBy("step").agg({"changes": "sum"}).withColumnRenamed("sum(changes)", "n").collect()} == {0: 60, 1: 90}
    apply_changes(changes, files_target(root, "new3"), journal)  # all is done: the target is not touched
    assert len(open(root + ".log").read().split("\n")[:-1]) == 150


def test_a_journal_belongs_to_its_table(spark, changes, tmp_path):
    root, journal = str(tmp_path / "tags"), str(tmp_path / "journal")
    apply_changes(changes, FolderTarget(root, 0), journal)
    with pytest.raises(ValueError, match="another change table"):
        apply_changes(changes.limit(3), FolderTarget(root, 0), journal)


def test_empty(spark, tmp_path):
    journal = str(tmp_path / "journal")
    assert apply_changes(spark.createDataFrame([], SCHEMA), FolderTarget(str(tmp_path / "tags"), 0), journal).count() == 0
    assert journal_chunks(spark, journal).count() == 0


def test_plans_one_after_another_in_a_folder(spark, tmp_path):
    root = str(tmp_path / "tags")
    first = [("tables", "a", "TYPE_x"), ("tables", "a", "own"), ("columns", "b", "TYPE_y")]
    FolderTarget.start(spark.createDataFrame(first, SCHEMA.rsplit(",", 1)[0]), root)
    assert {tuple(r) for r in FolderTarget.tags(spark, root).collect()} == set(first)
    mapping = spark.createDataFrame([("tables", "a", "z"), ("columns", "b", "y")], "type string, name string, tag string")
    for number, wanted in enumerate([mapping, mapping.replace("z", "x", subset=["tag"])]):
        now = FolderTarget.tags(spark, root)
        table = str(tmp_path / f"changes{number}")
        plan = tagsync.tag_sync_plan(wanted, now)
        tagsync.change_table(plan).write.parquet(table)
        want = {tuple(r) for r in tagsync.apply_plan(now, plan).collect()}
        apply_changes(spark.read.parquet(table), FolderTarget(root, number), str(tmp_path / f"journal{number}"))
        assert {tuple(r) for r in FolderTarget.tags(spark, root).collect()} == want
    assert {tuple(r) for r in FolderTarget.tags(spark, root).collect()} == set(first)
