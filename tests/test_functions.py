"""Scalar functions against plain-Python restatements."""

import re
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontocat.functions.scalars import (compact_iri, display_label, expand_curie, literal_value, local_name,
                                       mint_iri, mint_iri_parts, qualified_name)
from ontocat.functions.trigrams import trigrams
from ontocat.model import USER_NS

AWKWARD = ["a b", "x/y", "~t", "a*b", "é ü", "a'b(c)!", "100%", "a+b", "q?=&#", "", "plain.name-1_2"]


def _one(spark, col_fn, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


def test_mint_iri_matches_python_quote(spark):
    assert _one(spark, mint_iri, AWKWARD) == [USER_NS + quote(v) for v in AWKWARD]


def test_mint_iri_parts_matches_encode_uri_component(spark):
    df = spark.createDataFrame([(v, "s", "t") for v in AWKWARD], "a string, b string, c string")
    got = [r[0] for r in df.select(mint_iri_parts("a", "b", "c")).collect()]
    want = [USER_NS + quote(f"{v}.s.t", safe="-_.!~*'()") if v else None for v in AWKWARD]
    assert got == want


def test_qualified_and_local_names(spark):
    df = spark.createDataFrame([("main", "sales", "orders")], "a string, b string, c string")
    assert df.select(qualified_name("a", "b", "c")).first()[0] == "main.sales.orders"
    iris = ["http://x.org/a/b", "http://x.org/a#frag", "http://x.org/a/b#c", "plain", "http://x.org/a/"]
    assert _one(spark, local_name, iris) == [i.split("/")[-1].split("#")[-1] for i in iris]
    df2 = spark.createDataFrame([(None, "http://x.org/a/B"), ("", "u/C"), ("L", "u/D")], "l string, u string")
    assert [r[0] for r in df2.select(display_label("l", "u")).collect()] == ["B", "C", "L"]


def test_curie_round_trip(spark):
    curies = ["rdf:type", "skos:altLabel", "user:thing", "uc:Table", "bad:x", "nocolon"]
    full = _one(spark, expand_curie, curies)
    assert full[0] == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    assert full[2] == USER_NS + "thing"
    assert full[4] is None and full[5] is None
    back = _one(spark, compact_iri, [f for f in full if f])
    assert back == ["rdf:type", "skos:altLabel", "user:thing", "uc:Table"]


def test_literal_value(spark):
    df = spark.createDataFrame([("42", "xsd:integer"), ("x", "xsd:integer"), ("2.5", "xsd:double"),
                                ("true", "xsd:boolean"), ("2020-02-29", "xsd:date"), ("hi", None)],
                               "o string, dt string")
    v = literal_value(F.col("o"), F.col("dt"))
    rows = df.select(*[c.alias(n) for n, c in v.items()]).collect()
    assert rows[0].value_long == 42 and rows[1].value_long is None
    assert rows[2].value_double == 2.5 and rows[3].value_boolean is True
    assert str(rows[4].value_date) == "2020-02-29" and rows[5].value_string == "hi"


def py_trigrams(text: str) -> set[str]:
    out = set()
    for w in re.split(r"[^\w]|_", text.lower()):
        if w:
            p = "  " + w + " "
            out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcAB xy-1é", max_size=12), min_size=1, max_size=8))
def test_trigrams_match_python(spark, texts):
    got = _one(spark, trigrams, texts)
    assert [set(g) for g in got] == [py_trigrams(t) for t in texts]
    assert all(len(g) == len(set(g)) for g in got)


def test_search_equals_brute_force(spark):
    from conftest import make_graph
    from ontocat.operators.search import trigram_search

    texts = ["Nation 1", "nation", "ALGERIA", "Brand#12", "brand 13", "customer 7", "the customers",
             "word", "w", "", "x-y z", "Promo burnished", "PROMO"]
    g = make_graph(spark, [(f"s/{i}", "rdfs:label", t, "lit") for i, t in enumerate(texts)])
    queries = ["nation 1", "brand 12", "customer", "promo", "w", "zzz"]
    qs = spark.createDataFrame([(q,) for q in queries], "query string")
    got = sorted((r.query, r.text) for r in trigram_search(g, qs).collect())
    want = []
    for q in queries:
        a = py_trigrams(q)
        for t in texts:
            b = py_trigrams(t)
            inter = len(a & b)
            if inter and 10 * inter >= 3 * len(a | b):
                want.append((q, t))
    assert got == sorted(want)


def test_substring_join(spark):
    from ontocat.operators import search

    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(
        ["Alpha beta", "ALPHABET", "gamma", "x/y None", "ß straße", "", "ab"])], "uri string, text string")
    filters = spark.createDataFrame([(q,) for q in ("alp", "a", "BE", "none", "STRASSE", "ß", "zz", "")], "q string")
    joined = sorted(tuple(r) for r in search.substring_join(items, filters).select("uri", "q").collect())
    want = sorted((u, q) for u, t in [(str(i), t) for i, t in enumerate(
        ["Alpha beta", "ALPHABET", "gamma", "x/y None", "ß straße", "", "ab"])]
        for q in ("alp", "a", "BE", "none", "STRASSE", "ß", "zz", "") if q.upper() in t.upper())
    assert joined == want


def test_list_filter_with_very_many_alt_labels(spark):
    """One property of 1,100 alt labels: filters inside a label, over two neighbours, and over label, URI and name."""
    from conftest import make_graph
    from ontocat.operators import entities, search

    uri, alts = "http://example.org/p", sorted(f"label number {i:05d}" for i in range(1100))
    g = make_graph(spark, [(uri, "rdf:type", "rdf:Property"), (uri, "rdfs:label", "the name", "lit"),
                           *[(uri, "skos:altLabel", a, "lit") for a in alts]])
    two = [f"{a[-7:]} {b[:9]}" for a, b in zip(alts, alts[1:])][:200]
    more = [alts[7], f"{alts[-1]} {uri} the", "p THE NAME", " ", "", f"{alts[0]} {alts[2]}", None]
    found = search.list_filter(g, spark.createDataFrame([(q,) for q in two + more], "q string")).collect()
    assert {r.q for r in found} == {*two, *more[:5]} and len(found) == 205
    assert entities.property_detail(g, [uri]).count() == 1
    assert entities.property_detail(g, [uri]).first().n_alt_labels == 1100
    assert entities.alt_labels(g, uri).count() == 1100


def test_a_text_is_cut_into_trigrams_once(spark):
    from conftest import make_graph
    from ontocat.operators.search import trigram_search

    g = make_graph(spark, [("t/1", "uc:name", "main.promo", "lit"), ("t/2", "uc:name", "other", "lit")])
    found = trigram_search(g, spark.createDataFrame([("promo",)], "query string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "regexp_extract_all" in line and "query" not in line]
    assert sum(line.count("regexp_extract_all") for line in texts) == 1
    assert [(r.uri, r.text) for r in found.collect()] == [("t/1", "main.promo")]
