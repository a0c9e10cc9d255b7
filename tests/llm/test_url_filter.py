from ontocat.llm import queries, url_filter as U

PAGE = "page_id bigint, url string, html string, host string, token string, row string"


def judge(url, rules=queries.URL_RULES):
    """Every rule in turn."""
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for rule, verdict in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail if "/" in rule else ""):
            fits.append((-len(rule), rule, verdict))
    best = min(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme/en/", "http://example.net/en/1?x=http://a.org/fr/", "https://A.B.Example.NET/en/", "http://example.net/EN/",
        "http://notexample.net/en/", "http://net/", "http://net", "http://x.net?y", "http://x.net#y", "http://x.net/", "ftp://z.org/fr/1",
        "http://z.org/fr", "http://z.org/france/", "://q.net/a", "http://x.example.com/de/?q", "http://example.com:80/de/", "a://b://c.net/",
        "http://\u00c9.net/\n/x", "http://x.net/" + "a/" * 5000, "http:///path", "http://.net/", "http://exampleXnet/en/"]


def check(spark, pages, rules, **options):
    frame = spark.createDataFrame(rules, "rule string, verdict string")
    out = U.judge_urls(pages, frame, **options)
    got = sorted(((r.page_id, r.url, *r.judged) for r in out.collect()), key=repr)
    want = sorted(((r.page_id, r.url, *judge(r.url, [x for x in rules if x[0]])) for r in pages.collect()), key=repr)
    assert got == want
    return out


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, None, "kept", "kept", "kept") for i, u in enumerate(URLS)] + [(None, URLS[3], "h", "a", "b", "c")] * 2, PAGE)
    out = check(spark, pages, queries.URL_RULES)
    assert out.columns == [*pages.columns, "judged"]
    check(spark, pages, queries.URL_RULES, broadcast_bytes=0)


def test_more_rules(spark):
    rules = [("net/", "block"), ("net/", "block"), ("b.example.net/en", "block"), ("org/a/b/", "allow"), ("org/a/", "block"),
             ("x-y.org/(z)+/", "block"), ("com", "block"), (None, "block"), ("a.b.c.d.org/", "allow")]
    urls = ["http://b.example.net/english/1", "http://example.net/english", "http://q.org/a/b/c", "http://q.org/a/bc", "http://x-y.org/(z)+/1",
            "http://x-y.org/zz/1", "http://shop.com", "http://shop.com/de/", "http://a.b.c.d.org/", "http://b.c.d.org/"]
    pages = spark.createDataFrame([(i, u, None, "", "", "") for i, u in enumerate(urls)], PAGE)
    check(spark, pages, rules)


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], PAGE), spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/", None, "", "", "")], PAGE)
    none = spark.createDataFrame([], "rule string, verdict string")
    assert U.judge_urls(pages, none).select("judged.verdict").first()[0] == "allow"


def test_only_the_rarest_token_files_a_rule(spark):
    urls = spark.createDataFrame([(f"h{i}.example.net", "/en/" if i == 1 else "/de/") for i in range(20)], "host string, path string")
    rules = U.compile_rules(spark.createDataFrame([("example.net/en/", "allow"), ("net/", "block")], "rule string, verdict string"))
    assert {r.rule: r.token for r in U.index_rules(rules, urls).collect()} == {"example.net/en/": "/en", "net/": "net"}


def test_main_path_is_native(spark, capsys):
    queries.op6_url_filter(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


def test_pages_that_are_judged_already(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/", "kept", "x")], "page_id int, url string, judged string, host string")
    row = U.judge_urls(pages, rules).select("judged", "host", "_judged.verdict").first()
    assert tuple(row) == ("kept", "x", "block")
