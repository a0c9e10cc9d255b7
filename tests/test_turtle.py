"""Turtle import: abbreviations, directives, and the same triples however a file is split."""

import random

import pytest

from ontocat.sources import ntriples, turtle

TEXT = '''@prefix : <http://e/a/> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#>. # a comment with a stop . and <iri>
@base <http://e/base/dir/file> .
:A a rdfs:Class, :B ; rdfs:label "one. two; <three>"@EN-us , 'it''' + "\\'" + '''s' ;
   rdfs:comment """long . "quoted" ""
# no comment . [ """ ;;
   :n 1, -2.5 , 3e4, .5 ; :t true ; :d "2020-01-01"^^<http://www.w3.org/2001/XMLSchema#date>, "x"^^:own .
[ rdfs:label 'unnamed' ; :part [ :deep ( 1 "two" :A ) ] ] .
_:named :knows [], _:other.1 . :dotted.name :p :a.b.
PREFIX
 e: <http://e/x#> <rel> e:p%20q <../up>, <#frag>, () .
:A.B a e:last\\-one.
:A e:r \'\'\'single
"long" \'\'\' . @prefix : <http://e/second/> . :A :p :B.
nonsense here .
:A unbound:x 1 .
:ok a :C .
:cut a'''

OWN = "http://e/a/"
WANTED = {
    (f"{OWN}A", "rdf:type", "rdfs:Class", None, None), (f"{OWN}A", "rdf:type", f"{OWN}B", None, None),
    (f"{OWN}A", "rdfs:label", "one. two; <three>", None, "en-us"), (f"{OWN}A", "rdfs:label", "it's", None, None),
    (f"{OWN}A", "rdfs:comment", 'long . "quoted" ""\n# no comment . [ ', None, None),
    (f"{OWN}A", f"{OWN}n", "1", "xsd:integer", None), (f"{OWN}A", f"{OWN}n", "-2.5", "xsd:decimal", None), (f"{OWN}A", f"{OWN}n", "3e4", "xsd:double", None),
    (f"{OWN}A", f"{OWN}n", ".5", "xsd:decimal", None), (f"{OWN}A", f"{OWN}t", "true", "xsd:boolean", None),
    (f"{OWN}A", f"{OWN}d", "2020-01-01", "xsd:date", None), (f"{OWN}A", f"{OWN}d", "x", f"{OWN}own", None),
    ("_:", "rdfs:label", "unnamed", None, None), ("_:", f"{OWN}part", "_:", None, None), ("_:", f"{OWN}deep", "_:", None, None),
    ("_:", "rdf:first", "1", "xsd:integer", None), ("_:", "rdf:first", "two", None, None), ("_:", "rdf:first", f"{OWN}A", None, None),
    ("_:", "rdf:rest", "_:", None, None), ("_:", "rdf:rest", "rdf:nil", None, None), ("_:", f"{OWN}knows", "_:", None, None),
    (f"{OWN}dotted.name", f"{OWN}p", f"{OWN}a.b", None, None), ("http://e/base/dir/rel", "http://e/x#p%20q", "http://e/base/up", None, None),
    ("http://e/base/dir/rel", "http://e/x#p%20q", "http://e/base/dir/file#frag", None, None), ("http://e/base/dir/rel", "http://e/x#p%20q", "rdf:nil", None, None),
    (f"{OWN}A.B", "rdf:type", "http://e/x#last-one", None, None), (f"{OWN}A", "http://e/x#r", 'single\n"long" ', None, None),
    ("http://e/second/A", "http://e/second/p", "http://e/second/B", None, None), ("http://e/second/ok", "rdf:type", "http://e/second/C", None, None),
}
REJECTED = [":A unbound:x 1 .", ":cut a", "nonsense here ."]


def lines_of(spark, files, cuts):
    """Lines with a new split at each of the ``cuts`` (line numbers)."""
    rows = []
    for name, text in files.items():
        split = 0
        for at, line in enumerate(text.split("\n")):
            split = at if at in cuts else split
            rows.append((name, split, at, line, "kept"))
    return (spark.createDataFrame(rows, "file string, split bigint, at bigint, value string, base string")
            .repartition(4, "file", "split").sortWithinPartitions("file", "split", "at"))


def shown(triples):
    return {tuple("_:" if v and v.startswith("_:") else v for v in (r.s, r.p, r.o)) + (r.o_datatype, r.o_lang) for r in triples.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_any_split_gives_the_same(spark, seed):
    n = TEXT.count("\n") + 1
    cuts = {0: set(), 1: set(range(n))}.get(seed) if seed < 2 else set(random.Random(seed).sample(range(n), 6))
    triples, rejects = turtle.parse_turtle(lines_of(spark, {"f": TEXT}, cuts), "b")
    assert shown(triples) == WANTED
    assert sorted(r.value for r in rejects.collect()) == REJECTED
    assert triples.count() == 31


def test_files_do_not_share_prefixes_or_labels(spark):
    one, two = "@prefix : <http://one/> . _:x :p :a .", "_:x :p :a . @prefix : <http://two/> . _:x :p :a ."
    triples, rejects = turtle.parse_turtle(lines_of(spark, {"one": one, "two": two}, set()), "b")
    rows = triples.collect()
    assert {(r.p, r.o) for r in rows} == {("http://one/p", "http://one/a"), ("http://two/p", "http://two/a")}
    assert len({r.s for r in rows}) == 2
    assert [r.value for r in rejects.collect()] == ["_:x :p :a ."]


def test_ntriples_are_turtle(spark, graph_small):
    lines = ntriples.export_lines(graph_small.filter("pk != 'rdf:type|uc:Column'").limit(500))
    want = ntriples.parse_lines(lines)[0].collect()
    rows = [("f", i // 7, i, r.value) for i, r in enumerate(lines.collect())]
    own = spark.createDataFrame(rows, "file string, split bigint, at bigint, value string").repartition(3, "split").sortWithinPartitions("file", "split", "at")
    got, rejects = turtle.parse_turtle(own, "b")
    relative = {r for r in want if ":" not in r.s}  # derived graphs have relative subjects; without a base they are rejected
    assert rejects.count() >= 0 and {tuple(r) for r in got.collect()} <= {tuple(r) for r in want}
    assert len(relative) + got.count() >= len(want) - rejects.count()


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "file string, split bigint, at bigint, value string")
    assert [d.count() for d in turtle.parse_turtle(empty, "b")] == [0, 0]
    lines = lines_of(spark, {"f": "\n\n# only a comment"}, {1}).unionByName(spark.createDataFrame([("g", 0, 0, None, "")], "file string, split bigint, at bigint, value string, base string"))
    assert [d.count() for d in turtle.parse_turtle(lines, "b")] == [0, 0]


def test_states_meet(spark):
    for state in turtle.STATES:
        text = 'x """ y . \'\'\' z . """ . <http://a> . \'\'\' .'
        whole = turtle.advance(state, text)[0]
        assert whole in turtle.STATES
    assert turtle.advance(turtle.BETWEEN, 'a "x.y" 1.5 . b') == (turtle.INSIDE, [13])
    assert turtle.advance(turtle.LONG_DOUBLE, "no . end") == (turtle.LONG_DOUBLE, [])
    assert turtle.advance(turtle.BETWEEN, "PREFIX x: <http://x> a") == (turtle.INSIDE, [20])


def test_files_of_many_small_splits(spark, tmp_path):
    path = tmp_path / "sample.ttl"
    path.write_text(TEXT)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        lines = turtle.read_turtle(spark, str(path))
        triples, rejects = turtle.parse_turtle(lines, "b")
        assert lines.select("split").distinct().count() > 5
        assert shown(triples) == WANTED and rejects.count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_states_of_ranges_compose(spark):
    """What every split of a file starts in, by the ranges of its splits, is what one pass over them gives."""
    rng = random.Random(3)
    rows = [(f"f{i % 2}", i, [rng.choice(turtle.STATES) for _ in turtle.STATES], [rng.random() < 0.1 for _ in turtle.STATES]) for i in range(400)]
    summary = spark.createDataFrame(rng.sample(rows, len(rows)), "file string, split bigint, states array<int>, ended array<boolean>")
    wanted, at = set(), {}
    for file, split, states, ended in rows:
        state, owner = at.get(file, (turtle.BETWEEN, turtle.BEFORE))
        wanted.add((file, split, state, owner))
        at[file] = states[state], split if ended[state] else owner
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for merged in ("true", "false"):  # one range, and as many as there are tasks
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
            assert {tuple(r) for r in turtle._entered(summary).collect()} == wanted
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_terms_skipped_at_once_change_no_state():
    """Runs of terms that end nothing are skipped; ends and states are those of the terms one by one."""
    parts = ['"', '""', '"""', "'", "'''", ".", " . ", "1.5", "5e+3", "a", "word ", "uc:x", "uc:x.y", "<a.b>", "<a b>", "#", "\\", ";", "[", " ",
             "\u00e9", "\u6587\u5b57", "\u6587.", "_:b.", "@en", "PREFIX ", ".5e3", "-", "%20"]
    rng = random.Random(5)

    class Never:
        match = staticmethod(lambda line, at: None)

    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(5_000)]
    told = [[turtle.advance(s, line) for s in turtle.STATES] for line in lines]
    plain, turtle._PLAIN = turtle._PLAIN, Never
    try:
        assert told == [[turtle.advance(s, line) for s in turtle.STATES] for line in lines]
    finally:
        turtle._PLAIN = plain


@pytest.mark.parametrize("base", [None, "http://e/data/", "http://e/d/x", "http://e/a/../b/c", "urn:a:b"])
def test_simple_statements_are_expanded_as_others_are(monkeypatch, base):
    heads = ["<a/b> a ex:C", "<http://x/y> ex:p <../q>", "_:b1 <p> _:b2", "ex:s ex:p <a//b>", "<./a> a <d;e>"]
    tails = [';\n    ex:q "a; b . \\"c"', ', "t"@en-GB', ', "5"^^ex:int ; ex:r ""', '; <r> "1"^^<d>, "x\\\\"', ", ex:a.b", '; ex:p """long"""', ", 1.5", ", [ ]", "# c", ", a"]
    texts = [f"{head} {tail} {tail2} ." for head in heads for tail in ["", *tails] for tail2 in ["", *tails]]

    def found(text):
        try:
            return turtle.expand(text, base, "p")
        except turtle.Rejected:
            return None

    quick = [found(t) for t in texts]
    if base:
        assert sum(turtle._simple(t, base) is not None for t in texts) > 50
    monkeypatch.setattr(turtle, "_simple", lambda text, base: None)
    assert quick == [found(t) for t in texts]


def test_import_keeps_no_steps_and_equals_parse_and_merge(spark, monkeypatch):
    import os

    from ontocat.session import FREE_SHUFFLES
    from ontocat.sources import ntriples

    paths = []
    monkeypatch.setattr(turtle, "new_snapshot_path", lambda s, kind, of=turtle.new_snapshot_path: paths.append(of(s, kind)) or paths[-1])
    lines = lines_of(spark, {"f": TEXT, "g": TEXT + "\nnot a statement .\n<x> nosuch:p <y> ."}, set(range(0, len(TEXT), 7)))
    triples, rejects = turtle.parse_turtle(lines, "b")
    g = triples.limit(3)
    _, want = ntriples.merge_parsed(g, triples)
    want, want_rejects = sorted(map(repr, want.collect())), sorted(r.value for r in rejects.collect())
    paths.clear()
    own = spark.conf.get(FREE_SHUFFLES, None)
    merged, added, rejects = turtle.import_turtle(g, lines, "b")
    assert sorted(map(repr, added.collect())) == want and sorted(r.value for r in rejects.collect()) == want_rejects and want_rejects
    assert merged.count() == len(want) + 3
    large = [p for p in paths if "turtle-statements-" in p or "turtle-terms-" in p]
    assert len(large) == 2 and not any(os.path.exists(p.removeprefix("file:")) for p in large)
    assert spark.conf.get(FREE_SHUFFLES, None) == own
