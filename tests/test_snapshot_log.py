"""The snapshot log: what concurrent commits give is what they give one after another."""

import threading

import pytest
from pyspark.sql import functions as F

from conftest import make_graph
from ontocat.model import TRIPLE_COLUMNS, Vocab
from ontocat.operators.mutations import CHANGES, ChangeSet
from ontocat.plans import jobs
from ontocat.sources.snapshot_log import EVERYTHING, READS, Conflict, GraphLog

GRAPH = [("t/1", Vocab.TYPE, Vocab.TABLE), ("t/1", Vocab.NAME, "one", "lit"), ("c/1", Vocab.TYPE, Vocab.CLASS),
         ("c/1", Vocab.LABEL, "first", "lit"), ("t/1", Vocab.CONCEPT_ASSIGNMENT, "c/1")]


@pytest.fixture
def log(spark, tmp_path):
    log = GraphLog(spark, str(tmp_path / "log"))
    log.start(make_graph(spark, GRAPH))
    return log


def added(spark, *rows):
    return ChangeSet(make_graph(spark, rows))


def triples(g):
    return {tuple(r)[:3] for r in g.select(*TRIPLE_COLUMNS).collect()}


def test_versions_stay_readable(spark, log):
    log.commit(lambda g: added(spark, ("c/2", Vocab.TYPE, Vocab.CLASS)))
    last = log.commit(lambda g: ChangeSet(removals=spark.createDataFrame([("c/1",)], "s string"), keys=("s",)), (EVERYTHING,))
    assert last.number == 2 and triples(log.open(0)) == {r[:3] for r in GRAPH}
    assert triples(log.open(1)) == {r[:3] for r in GRAPH} | {("c/2", Vocab.TYPE, Vocab.CLASS)}
    assert triples(log.open()) == {r[:3] for r in GRAPH if r[0] != "c/1"} | {("c/2", Vocab.TYPE, Vocab.CLASS)}
    assert log.commit(lambda g: ChangeSet()).number == 2  # nothing to change, no commit


def test_disjoint_commits_both_land_without_a_second_plan(spark, log):
    plans = []

    def slow(g):
        plans.append(g)
        if len(plans) == 1:
            log.commit(lambda h: added(spark, ("c/1", Vocab.LABEL, "second", "lit")))
        return added(spark, ("t/1", Vocab.CONCEPT_ASSIGNMENT, "c/2"))

    entry = log.commit(slow)
    assert len(plans) == 1 and entry.number == 2
    assert triples(log.open()) == {r[:3] for r in GRAPH} | {("c/1", Vocab.LABEL, "second"), ("t/1", Vocab.CONCEPT_ASSIGNMENT, "c/2")}


def test_overlapping_commit_is_planned_again(spark, log):
    seen = []

    def rename(g):
        """Every label of c/1 gets a mark, as it is read."""
        labels = [r.o for r in g.filter(F.col("p") == Vocab.LABEL).collect()]
        seen.append(sorted(labels))
        if len(seen) == 1:
            log.commit(lambda h: added(spark, ("c/1", Vocab.LABEL, "second", "lit")))
        return ChangeSet(make_graph(spark, [("c/1", Vocab.LABEL, f"{x}!", "lit") for x in labels]),
                         spark.createDataFrame([("c/1", Vocab.LABEL)], "s string, p string"))

    assert log.commit(rename).number == 2
    assert seen == [["first"], ["first", "second"]]
    assert {o for _, p, o in triples(log.open()) if p == Vocab.LABEL} == {"first!", "second!"}


def test_what_a_plan_has_read_counts(spark, log):
    """A registration looks at types; a removal of the subject meanwhile makes it look again."""
    cmds = spark.createDataFrame([(1, "t/1", "anew")], "seq int, uri string, name string")
    plan, calls = CHANGES["register-tables"], []

    def register(g):
        calls.append(1)
        change = plan(g, cmds).additions.collect()
        if len(calls) == 1:
            log.commit(lambda h: ChangeSet(removals=spark.createDataFrame([("t/1",)], "s string"), keys=("s",)), READS["delete-objects"])
        return added(spark, *[tuple(r)[:4] for r in change]) if change else added(spark, ("x", "http://e/other", "y"))

    log.commit(register, READS["register-tables"])
    assert len(calls) == 2 and ("t/1", Vocab.NAME, "anew") in triples(log.open())


def test_threads(spark, log):
    def write(i):
        for n in range(2):
            log.commit(lambda g: added(spark, (f"c/{i}", (Vocab.BROADER, Vocab.NARROWER)[i % 2], f"c/{n}")))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.latest().number == 8
    assert {t for t in triples(log.open()) if t[0].startswith("c/") and t[1] in (Vocab.BROADER, Vocab.NARROWER)} == {
        (f"c/{i}", (Vocab.BROADER, Vocab.NARROWER)[i % 2], f"c/{n}") for i in range(4) for n in range(2)}


def test_a_number_is_claimed_once(spark, log):
    entry = log.latest()
    assert not log._publish(entry)
    with pytest.raises(Conflict):
        log.start(make_graph(spark, GRAPH))

    def always(g):
        log.commit(lambda h: added(spark, ("c/1", Vocab.LABEL, f"n{log.latest().number}", "lit")))
        return added(spark, ("c/1", Vocab.LABEL, "mine", "lit"))

    with pytest.raises(Conflict):
        log.commit(always, attempts=2)


def test_nothing_reachable_is_removed(spark, log):
    for n in range(3):
        log.commit(lambda g: added(spark, ("c/1", Vocab.LABEL, f"l{n}", "lit")))
    before = triples(log.open())
    assert log.remove_unreferenced(keep=1, min_age=3_600) == []  # too young
    gone = log.remove_unreferenced(keep=2, min_age=-60)
    assert len(gone) == 1 and log._numbers() == [2, 3] and len(triples(log.open(2))) == len(before) - 1
    assert log.remove_unreferenced(keep=1, min_age=-60) and triples(log.open()) == before
    late = log.entry(3)
    assert log._overtaken(type(late)(0, late.folders), {"any"}) is None  # numbers in between are gone: plan again


def test_logged_commands(spark, log, tmp_path):
    cmds = spark.createDataFrame([(1, "t/9", "c/1"), (2, None, "c/1")], "seq int, entity_uri string, target_uri string")
    cmds.write.parquet(str(tmp_path / "cmds"))
    out = jobs.apply_logged(spark, log.root, "assign-concepts", str(tmp_path / "cmds"))
    assert out["commit"] == "1" and ("t/9", Vocab.CONCEPT_ASSIGNMENT, "c/1") in triples(log.open())
    assert spark.read.parquet(out["rejects"]).count() == 1


def test_empty_log(spark, tmp_path):
    log = GraphLog(spark, str(tmp_path / "none"))
    assert log.latest().number == -1 and log.open().count() == 0
    assert log.commit(lambda g: added(spark, ("a", Vocab.LABEL, "b", "lit"))).number == 0
    assert triples(log.open()) == {("a", Vocab.LABEL, "b")}
