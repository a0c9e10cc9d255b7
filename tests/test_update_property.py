"""Batch updates equal the same commands applied one call at a time."""

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import make_graph
from ontocat.operators import mutations as mut

URIS = st.sampled_from(["u/1", "u/2", "u/3"])
TEXT = st.sampled_from(["", "a", "b"])
ALTS = st.one_of(st.none(), st.lists(st.sampled_from(["x", "y"]), max_size=2, unique=True))

BASE = [("u/1", "rdfs:label", "old", "lit"), ("u/1", "rdfs:comment", "c0", "lit"),
        ("u/1", "skos:altLabel", "z", "lit"), ("u/2", "rdfs:label", "L2", "lit"),
        ("u/9", "rdfs:label", "keep", "lit")]


def sequential(cmds):
    """One reference call per command, in seq order, on a set of (s, p, o)."""
    g = {(s, p, o) for s, p, o, _ in BASE}
    for _, uri, label, comment, alts in cmds:
        g = {t for t in g if not (t[0] == uri and t[1] == "rdfs:label")} | {(uri, "rdfs:label", label)}
        if comment:
            g = {t for t in g if not (t[0] == uri and t[1] == "rdfs:comment")} | {(uri, "rdfs:comment", comment)}
        if alts is not None:
            g = {t for t in g if not (t[0] == uri and t[1] == "skos:altLabel")}
            g |= {(uri, "skos:altLabel", a) for a in alts}
    return g


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(URIS, TEXT, TEXT, ALTS), min_size=1, max_size=6))
def test_update_concepts_is_sequential(spark, cmds):
    rows = [(i, u, label, comment, alts) for i, (u, label, comment, alts) in enumerate(cmds)]
    batch = spark.createDataFrame(rows, "seq long, uri string, label string, comment string, "
                                        "alt_labels array<string>")
    got = {(r.s, r.p, r.o) for r in mut.update_concepts(make_graph(spark, BASE), batch).collect()}
    assert got == sequential(rows)


PBASE = [("p/1", "rdfs:label", "P", "lit"), ("p/1", "rdfs:comment", "c0", "lit"),
         ("p/1", "rdfs:domain", "d/0", "iri"), ("p/1", "rdfs:range", "r/0", "iri"),
         ("p/1", "skos:altLabel", "z", "lit"), ("p/2", "rdfs:label", "Q", "lit")]
PURIS = st.sampled_from(["p/1", "p/2"])
OPT = st.sampled_from([None, "", " ", "v", " v "])


def sequential_props(cmds):
    g = {(s, p, o) for s, p, o, _ in PBASE}

    def clean(x):
        return x.strip() or None if x is not None else None

    for _, uri, label, comment, domain, rng, alts in cmds:
        g = {t for t in g if not (t[0] == uri and t[1] in ("rdfs:label", "rdfs:comment", "rdfs:domain",
                                                            "rdfs:range"))}
        g.add((uri, "rdfs:label", label))
        for pred, val in (("rdfs:comment", clean(comment)), ("rdfs:domain", clean(domain)),
                          ("rdfs:range", clean(rng))):
            if val:
                g.add((uri, pred, val))
        if alts is not None:
            g = {t for t in g if not (t[0] == uri and t[1] == "skos:altLabel")}
            g |= {(uri, "skos:altLabel", a) for a in alts}
    return g


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(PURIS, TEXT, OPT, OPT, OPT, ALTS), min_size=1, max_size=5))
def test_update_properties_is_sequential(spark, cmds):
    rows = [(i, *c) for i, c in enumerate(cmds)]
    batch = spark.createDataFrame(rows, "seq long, uri string, label string, comment string, domain string, "
                                        "range string, alt_labels array<string>")
    got = {(r.s, r.p, r.o) for r in mut.update_properties(make_graph(spark, PBASE), batch).collect()}
    assert got == sequential_props(rows)


TBASE = [("t/1", "rdf:type", "uc:Table", "iri"), ("t/1", "uc:name", "a.b.c", "lit"),
         ("t/2", "uc:name", "untyped", "lit")]


def sequential_tables(cmds):
    from urllib.parse import quote

    g = {(s, p, o) for s, p, o, _ in TBASE}
    for _, uri, name in cmds:
        uri = uri or "http://example.com/ontology/" + quote(name)
        if (uri, "rdf:type", "uc:Table") not in g:
            g |= {(uri, "rdf:type", "uc:Table"), (uri, "uc:name", name)}
    return g


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "t/1", "t/2", "t/3"]),
                          st.sampled_from(["x y", "a.b.c", "n/1", "q"])), min_size=1, max_size=6))
def test_upsert_tables_is_sequential(spark, cmds):
    rows = [(i, u, n) for i, (u, n) in enumerate(cmds)]
    batch = spark.createDataFrame(rows, "seq long, uri string, name string")
    got = {(r.s, r.p, r.o) for r in mut.upsert_tables(make_graph(spark, TBASE), batch).collect()}
    assert got == sequential_tables(rows)
