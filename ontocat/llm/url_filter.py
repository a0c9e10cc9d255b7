"""URL rules, indexed by their rarest literal token. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontocat.llm.common import free_name, lower_ascii

#: A rule table of more bytes is joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; '' without ``://`` or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Labels of the host and segments of the path, with '' (which every url has) for rules without a literal."""
    return F.array_distinct(F.concat(F.split(host, r"\."), F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("/"), s)),
                                     F.array(F.lit(""))))


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rules (rule, verdict)`` like ``example.net/en/`` with their regular expression and literal tokens.

    The expression is held against host + path: any subdomain, the rule's host,
    then its path as a prefix. The last segment of a path that does not end in
    ``/`` may go on in the url, so it is no token. Null rules are left out.
    """
    host, path = F.substring_index("rule", "/", 1), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1)
    quoted = F.regexp_replace("rule", r"([\\.\[\]{}()*+\-?^$|#&~<>=!:])", r"\\$1")
    whole = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    literals = F.concat(F.split(host, r"\."), F.transform(whole, lambda s: F.concat(F.lit("/"), s)))
    return (rules.select("rule", "verdict").filter("rule is not null").distinct()
            .withColumn("pattern", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted))
            .withColumn("tokens", F.array_distinct(F.concat(F.filter(literals, lambda t: (t != "") & (t != "/")),
                                                            F.array(F.lit(""))))))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each compiled rule under the one of its tokens that the fewest urls have (ties: the smallest token)."""
    wanted = rules.select("rule", F.explode("tokens").alias("token"))
    seen = (urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
            .join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (wanted.join(seen, "token", "left").groupBy("rule")
              .agg(F.min(F.struct((F.col("token") == "").alias("any"), F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"]
                   .alias("token")))
    return rules.drop("tokens").join(rarest, "rule")


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow",
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with a struct column ``judged``: host, path, longest fitting rule and verdict.

    The tokens of a url fetch the rules filed under them; only those run their
    regular expression. The best candidate of a row is kept while the row's
    tokens are still in one task, so what is shuffled is one small row per
    page, keyed by the row and thus without hot keys. The rule index is
    broadcast after its size has been checked, and joined by a shuffle beyond
    ``broadcast_bytes``.

    Of several fitting rules the longest wins (ties: the smaller rule, then the
    smaller verdict). Null urls and urls without ``://`` have an empty host and
    path and fit no rule. Without a fitting rule, ``rule`` is null and the
    verdict is ``default``. Rows are judged one by one, also repeated ones; all
    columns of ``pages`` are kept; if one is called ``judged``, the new one is
    ``_judged`` (with more underscores if need be).
    """
    out = free_name(pages, "judged")
    compiled = compile_rules(rules)
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    index = index_rules(compiled, rows)
    size = compiled.agg(F.sum(F.length("rule") * 2 + F.length("pattern") + 64)).first()[0] or 0
    index = F.broadcast(index) if size <= broadcast_bytes else index
    found = (rows.withColumn("row", F.monotonically_increasing_id())
             .withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
             .join(index, "token", "left"))
    fits = F.col("pattern").isNotNull() & F.regexp_like(F.concat("host", "path"), F.col("pattern"))
    best = F.when(fits, F.struct((-F.length("rule")).alias("short"), "rule", "verdict"))
    return (found.select("row", "page", "host", "path", "token", best.alias("best"))
            .filter("best is not null or token = ''").groupBy("row").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"),
                                F.min("best").alias("best"))
            .select("page.*", F.struct("host", "path", F.col("best.rule").alias("rule"),
                                       F.coalesce("best.verdict", F.lit(default)).alias("verdict")).alias(out)))

