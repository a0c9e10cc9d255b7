"""A mixed command log equals its commands, one by one in their order."""

import random
from urllib.parse import quote

import pytest

from conftest import make_graph
from ontocat.model import Vocab as V
from ontocat.operators import joins
from ontocat.operators.command_log import LOG_FIELDS, apply_log, log_changes
from ontocat.operators.mutations import CHANGES
from ontocat.sources.snapshot_log import EVERYTHING, GraphLog

SCHEMA = ", ".join(f"{k} {t}" for k, t in LOG_FIELDS.items())
BASE = [("u/1", V.TYPE, V.TABLE), ("u/1", V.NAME, "n1", "lit"), ("u/2", V.LABEL, "l2", "lit"), ("u/2", V.ALT_LABEL, "x", "lit"),
        ("u/2", V.COMMENT, "c", "lit"), ("u/3", V.BROADER, "u/1"), ("u/3", V.DOMAIN, "u/2"), ("u/9", V.LABEL, "kept", "lit")]
USER = "http://example.com/ontology/"


def one(g, c):
    """One call on a set of (s, p, o, kind); False if it is rejected."""
    _, kind, uri, name, label, typ, comment, domain, rng, alts, pred, target = c
    full = {"skos:broader": V.BROADER, "rdf:type": V.TYPE}.get(pred)
    if kind in ("register-tables", "register-columns"):
        cls = V.TABLE if kind == "register-tables" else V.COLUMN
        if name is None:
            return False
        uri = uri or USER + quote(name)
        if (uri, V.TYPE, cls, "iri") not in g:
            g |= {(uri, V.TYPE, cls, "iri"), (uri, V.NAME, name, "lit")}
    elif kind in ("insert-concepts", "insert-properties"):
        concept = kind == "insert-concepts"
        if label is None or concept and typ not in ("rdfs_class", "skos_concept"):
            return False
        uri = uri or USER + quote(label)
        g |= {(uri, V.TYPE, {"rdfs_class": V.CLASS, "skos_concept": V.CONCEPT}[typ] if concept else V.PROPERTY, "iri"), (uri, V.LABEL, label, "lit")}
        g |= {(uri, V.ALT_LABEL, a, "lit") for a in alts or [] if a is not None}
        for p, v, k in ((V.COMMENT, comment, "lit"),) if concept else ((V.DOMAIN, domain, "iri"), (V.RANGE, rng, "iri")):
            if v:
                g.add((uri, p, v, k))
    elif kind in ("update-concepts", "update-properties"):
        if not uri or label is None:
            return False
        if kind == "update-concepts":
            new = [(V.LABEL, label, "lit")] + [(V.COMMENT, comment, "lit")] * bool(comment)
        else:
            new = [(V.LABEL, label, "lit")] + [(p, (v or "").strip() or None, k) for p, v, k in
                                               ((V.COMMENT, comment, "lit"), (V.DOMAIN, domain, "iri"), (V.RANGE, rng, "iri"))]
        gone = {p for p, _, _ in new} | ({V.ALT_LABEL} if alts is not None else set())
        g -= {t for t in g if t[0] == uri and t[1] in gone}
        g |= {(uri, p, v, k) for p, v, k in new if v is not None} | {(uri, V.ALT_LABEL, a, "lit") for a in alts or [] if a is not None}
    elif kind in ("add-relationships", "delete-relationships"):
        if not (uri and target and full):
            return False
        (g.add if kind[0] == "a" else g.discard)((uri, full, target, "iri"))
    elif kind in ("assign-concepts", "assign-properties"):
        if not (uri and target):
            return False
        g.add((uri, V.CONCEPT_ASSIGNMENT if kind == "assign-concepts" else V.PROPERTY_ASSIGNMENT, target, "iri"))
    elif kind == "delete-objects":
        if not uri:
            return False
        g -= {t for t in g if t[0] == uri}
    else:
        return False
    return True


def random_log(rng, n):
    uris = ["u/1", "u/2", "u/3", "u/4", None, ""]
    kinds = [k for k in CHANGES if k != "register-inventory"] + ["delete-objects", "other", None]
    return [(i * 2, rng.choice(kinds), rng.choice(uris), rng.choice(["a b", "n/1", None]), rng.choice(["l1", "l2", "", None]),
             rng.choice(["rdfs_class", "skos_concept", "bogus"]), rng.choice(["", "c1", " ", None]), rng.choice(["u/1", " u/2 ", "", None]),
             rng.choice(["u/3", None]), rng.choice([None, [], ["x"], ["y", None, "z"]]), rng.choice(["skos:broader", "rdf:type", "rdf:type", "bad:x", None]),
             rng.choice(["u/1", V.TABLE, V.COLUMN, None])) for i in range(n)]


def replay(rows, base=BASE):
    g, rejected = {(*t[:3], t[3] if len(t) > 3 else "iri") for t in base}, []
    for c in rows:
        if not one(g, c):
            rejected.append(c[0])
    return g, rejected


def quads(g):
    rows = [(r.s, r.p, r.o, r.o_kind) for r in g.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(8))
def test_equals_one_call_after_another(spark, seed):
    rng = random.Random(seed)
    rows = random_log(rng, rng.choice([3, 20, 60, 200]))
    want, rejected = replay(rows)
    got, left_out = apply_log(make_graph(spark, BASE), spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA))
    assert quads(got) == want
    assert sorted(r.seq for r in left_out.collect()) == rejected


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    rows = random_log(random.Random(99), 80)
    monkeypatch.setattr(joins.broadcast_if_bounded, "__defaults__", (0, 0))
    assert quads(apply_log(make_graph(spark, BASE), spark.createDataFrame(rows, SCHEMA))[0]) == replay(rows)[0]


def test_empty_and_partial_logs(spark):
    g = make_graph(spark, BASE)
    want = quads(g)
    assert quads(apply_log(g, spark.createDataFrame([], SCHEMA))[0]) == want
    short = spark.createDataFrame([(1, "delete-objects", "u/9", "kept")], "seq int, kind string, uri string, score string")
    assert quads(apply_log(g, short)[0]) == {t for t in want if t[0] != "u/9"}
    nameless, rejected = apply_log(g, spark.createDataFrame([(1, "register-tables", "u/9")], "seq int, kind string, uri string"))
    assert quads(nameless) == want and rejected.count() == 1


def test_logs_are_commits(spark, tmp_path):
    log = GraphLog(spark, str(tmp_path / "log"))
    log.start(make_graph(spark, BASE))
    rng, want = random.Random(5), None
    whole = []
    for _ in range(3):
        rows = [(len(whole) * 2 + i, *c[1:]) for i, c in enumerate(random_log(rng, 15))]
        whole += rows
        log.commit(lambda g: log_changes(g, spark.createDataFrame(rows, SCHEMA)), (EVERYTHING,))
    want, _ = replay(whole)
    assert quads(log.open()) == want


def test_event_tasks_grow_with_the_log(spark, monkeypatch):
    """A log that is one file's split is dealt to as many tasks as its commands need."""
    from ontocat.model import empty_graph
    from ontocat.operators import command_log

    monkeypatch.setattr(command_log, "TASK_COMMANDS", 10)
    paths, fresh = [], command_log.new_snapshot_path
    monkeypatch.setattr(command_log, "new_snapshot_path", lambda s, kind: paths.append((kind, fresh(s, kind))) or paths[-1][1])
    log = spark.range(100).selectExpr("id AS seq", "'register-tables' AS kind", "concat('t/', id) AS uri", "'n' AS name").coalesce(1)
    change = command_log.log_changes(empty_graph(spark), log)
    assert change.additions.count() == 200
    events = spark.read.parquet(dict(paths)["command-events"])
    assert len(events.inputFiles()) == 10
