"""Command tables for the batch mutations and catalog registration, derived from driver tables.

Schemas follow FIXTURES.md §4. Each batch covers the edge cases of its
operator: URIs that already exist, a URI repeated within the batch, an empty
URI to be minted from the name, empty versus NULL alt-label lists, empty
comments, an unknown CURIE prefix, missing fields and dangling references.
The same rows are produced by the SQL in :mod:`ontocat.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontocat.sources.fixtures import read_table
from ontocat.sources.ntriples import escape


# Vocabulary IRIs given in full.
_OWL_THING = "http://www.w3.org/2002/07/owl#Thing"
_XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _rows(df: DataFrame, *structs: Column) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def _null_s() -> Column:
    return F.lit(None).cast("string")


def _null_a() -> Column:
    return F.lit(None).cast("array<string>")


def _empty_a() -> Column:
    return F.array().cast("array<string>")


def table_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 ``(seq, uri, name)`` from suppliers."""
    s = read_table(spark, sf_dir, "supplier")
    k, nk, nm = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_name")
    return _rows(
        s,
        F.struct((k * 3).cast("bigint").alias("seq"), _cat("t/", k).alias("uri"),
                 _cat("main.suppliers.", F.regexp_replace(nm, "#", "_")).alias("name")),
        F.struct((k * 3 + 1).cast("bigint").alias("seq"), _cat("ts/", nk).alias("uri"),
                 _cat("main.nations.", F.regexp_replace(nm, "#", "_")).alias("name")),
        F.struct((k * 3 + 2).cast("bigint").alias("seq"), _null_s().alias("uri"),
                 _cat("main.", nk, ".", nm).alias("name")),
    )


def column_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 ``(seq, uri, name)`` from parts."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return _rows(
        p,
        F.struct((k * 2).cast("bigint").alias("seq"), _cat("c/", k).alias("uri"),
                 _cat("main.parts.", F.regexp_replace("p_brand", "#", "_"), ".p", k).alias("name")),
        F.struct((k * 2 + 1).cast("bigint").alias("seq"), _null_s().alias("uri"),
                 _cat("main.parts.", F.col("p_brand"), ".", F.col("p_name")).alias("name")),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 ``(catalog, schema, table, column)``: every customer as a table, every order as a column."""
    c = read_table(spark, sf_dir, "customer")
    o = read_table(spark, sf_dir, "orders")
    t = c.select(F.lit("main").alias("catalog"), F.lower("c_mktsegment").alias("schema"),
                 F.regexp_replace("c_name", "#", "_").alias("table"), _null_s().alias("column"))
    cols = o.join(c, o.o_custkey == c.c_custkey).select(
        F.lit("main").alias("catalog"), F.lower("c_mktsegment").alias("schema"),
        F.regexp_replace("c_name", "#", "_").alias("table"), _cat("o", F.col("o_orderkey")).alias("column"))
    return t.unionByName(cols)


def concept_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3 ``(seq, uri, label, type, comment, alt_labels)`` from nations and parts."""
    n = read_table(spark, sf_dir, "nation")
    k, rk, nm = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name")
    nat = n.select(
        k.cast("bigint").alias("seq"),
        F.when(rk == 3, _null_s()).otherwise(_cat("n/", k)).alias("uri"),
        _cat("Nation ", nm).alias("label"),
        F.when(k % 2 == 0, "rdfs_class").when(k % 3 == 0, "skos_concept").otherwise("bogus").alias("type"),
        F.when(rk == 0, F.lit("")).otherwise(_cat("from ", nm)).alias("comment"),
        F.when(rk == 1, _null_a()).when(rk == 2, _empty_a()).otherwise(F.array(F.lower(nm), _cat("x ", nm)))
        .alias("alt_labels"),
    )
    p = read_table(spark, sf_dir, "part")
    prt = p.select(
        (F.col("p_partkey") + 100).cast("bigint").alias("seq"),
        _cat("ty/", F.col("p_type")).alias("uri"),
        F.col("p_type").alias("label"),
        F.lit("skos_concept").alias("type"),
        F.lit("").alias("comment"),
        F.array(F.col("p_brand")).alias("alt_labels"),
    )
    return nat.unionByName(prt)


def property_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 ``(seq, uri, label, domain, range, alt_labels)`` from regions and suppliers."""
    r = read_table(spark, sf_dir, "region")
    k, nm = F.col("r_regionkey"), F.col("r_name")
    reg = r.select(
        k.cast("bigint").alias("seq"),
        F.when(k == 0, _null_s()).otherwise(_cat("pr/", k)).alias("uri"),
        _cat(nm, " property").alias("label"),
        _cat("r/", k).alias("domain"),
        F.when(k == 2, F.lit(_XSD_STRING)).when(k % 2 == 0, _cat("n/", k)).otherwise(F.lit("")).alias("range"),
        F.array(F.lower(nm)).alias("alt_labels"),
    )
    s = read_table(spark, sf_dir, "supplier")
    sup = s.select(
        (F.col("s_suppkey") + 100).cast("bigint").alias("seq"),
        _cat("sp/", F.col("s_nationkey")).alias("uri"),
        _cat("Supplier ", F.col("s_nationkey")).alias("label"),
        _cat("n/", F.col("s_nationkey")).alias("domain"),
        _null_s().alias("range"),
        F.array(F.col("s_name")).alias("alt_labels"),
    )
    return reg.unionByName(sup)


def concept_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5 ``(seq, uri, label, comment, alt_labels)``: several updates per concept."""
    n = read_table(spark, sf_dir, "nation")
    k, rk, nm = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name")
    nat = _rows(
        n,
        F.struct((k * 2).cast("bigint").alias("seq"), _cat("n/", k).alias("uri"), F.upper(nm).alias("label"),
                 _cat("c1 ", nm).alias("comment"), _null_a().alias("alt_labels")),
        F.struct((k * 2 + 1).cast("bigint").alias("seq"), _cat("n/", k % 10).alias("uri"),
                 _cat("L2 ", nm).alias("label"),
                 F.when(rk.isin(0, 1), F.lit("")).otherwise(_cat("c2 ", nm)).alias("comment"),
                 F.when(rk == 2, _empty_a()).when(rk == 3, F.array(_cat("a2 ", nm))).otherwise(_null_a())
                 .alias("alt_labels")),
    )
    c = read_table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    cus = c.select(
        (ck + 100).cast("bigint").alias("seq"),
        _cat("n/", F.col("c_nationkey")).alias("uri"),
        _cat("L ", F.col("c_name")).alias("label"),
        F.when(ck % 2 == 0, F.lit("")).otherwise(_cat("C ", F.col("c_name"))).alias("comment"),
        F.when(ck % 3 == 0, F.array(_cat("ca ", F.col("c_name")))).otherwise(_null_a()).alias("alt_labels"),
    )
    return nat.unionByName(cus)


def property_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6 ``(seq, uri, label, comment, domain, range, alt_labels)``: many updates per property."""
    r = read_table(spark, sf_dir, "region")
    k, nm = F.col("r_regionkey"), F.col("r_name")
    reg = r.select(
        k.cast("bigint").alias("seq"), _cat("pr/", k + 1).alias("uri"), _cat("P ", nm).alias("label"),
        _cat("pc ", nm).alias("comment"), _cat("r/", k).alias("domain"), F.lit(" ").alias("range"),
        _null_a().alias("alt_labels"),
    )
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    ords = o.select(
        (ok + 100).cast("bigint").alias("seq"),
        _cat("pr/", F.substring("o_orderpriority", 1, 1)).alias("uri"),
        _cat("P ", ok).alias("label"),
        F.when(ok % 2 == 0, F.lit(" ")).otherwise(_cat("pc ", ok)).alias("comment"),
        _cat("r/", ok % 5).alias("domain"),
        F.when(ok % 3 == 0, F.lit("")).otherwise(_cat("n/", ok % 25)).alias("range"),
        F.when(ok % 4 == 0, F.array(_cat("pa ", ok))).otherwise(_null_a()).alias("alt_labels"),
    )
    return reg.unionByName(ords)


def relationship_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7 ``(seq, subject_uri, predicate_type, object_uri)``; includes an unknown prefix and
    a missing object (both rejected) and a non-vocabulary predicate (stored in full)."""
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    nat = n.select(
        k.cast("bigint").alias("seq"),
        _cat("n/", k).alias("subject_uri"),
        F.when(k % 4 == 0, "skos:broader").when(k % 4 == 1, "rdfs:subClassOf").when(k % 4 == 2, "user:relatedTo")
        .otherwise("bad:thing").alias("predicate_type"),
        F.when(F.col("n_regionkey") == 4, _null_s()).when(F.col("n_regionkey") == 3, F.lit(_OWL_THING))
        .otherwise(_cat("r/", (k + 1) % 5)).alias("object_uri"),
    )
    p = read_table(spark, sf_dir, "part")
    prt = p.select(
        (F.col("p_partkey") + 100).cast("bigint").alias("seq"),
        _cat("ty/", F.col("p_type")).alias("subject_uri"),
        F.lit("skos:related").alias("predicate_type"),
        _cat("b/", F.regexp_replace("p_brand", "#", "")).alias("object_uri"),
    )
    return nat.unionByName(prt)


def relationship_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: hierarchy edges of nations and the narrower edges of large parts' types; an unknown
    prefix and an empty object (both rejected)."""
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    nat = _rows(
        n,
        F.struct((k * 2).cast("bigint").alias("seq"), _cat("n/", k).alias("subject_uri"),
                 F.lit("rdfs:subClassOf").alias("predicate_type"),
                 _cat("r/", F.col("n_regionkey")).alias("object_uri")),
        F.struct((k * 2 + 1).cast("bigint").alias("seq"), _cat("n/", k).alias("subject_uri"),
                 F.lit("skos:broader").alias("predicate_type"),
                 _cat("r/", F.col("n_regionkey")).alias("object_uri")),
    )
    p = read_table(spark, sf_dir, "part")
    prt = p.filter(F.col("p_size") > 25).select(
        (F.col("p_partkey") + 100).cast("bigint").alias("seq"),
        _cat("ty/", F.col("p_type")).alias("subject_uri"),
        F.lit("skos:narrower").alias("predicate_type"),
        _cat("b/", F.regexp_replace("p_brand", "#", "")).alias("object_uri"),
    )
    bad = n.filter(k % 6 == 5).select(
        (k + 1_000_000_000).cast("bigint").alias("seq"), _cat("n/", k).alias("subject_uri"),
        F.when(k % 4 == 1, "bad:thing").otherwise("rdfs:subClassOf").alias("predicate_type"),
        F.when(k % 4 == 1, _cat("r/", k)).otherwise(F.lit("")).alias("object_uri"))
    return nat.unionByName(prt).unionByName(bad)


def concept_assignment_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9 ``(seq, entity_uri, target_uri)``: a new region assignment and an existing one per table."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return _rows(
        c,
        F.struct((k * 2).cast("bigint").alias("seq"), _cat("t/", k).alias("entity_uri"),
                 _cat("r/", F.col("c_nationkey") % 5).alias("target_uri")),
        F.struct((k * 2 + 1).cast("bigint").alias("seq"), _cat("t/", k).alias("entity_uri"),
                 _cat("n/", F.col("c_nationkey")).alias("target_uri")),
    )


def property_assignment_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U10 ``(seq, entity_uri, target_uri)`` for every order column."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.cast("bigint").alias("seq"), _cat("c/", k).alias("entity_uri"),
                    _cat("pr/", k % 5 + 1).alias("target_uri"))


def delete_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U11 ``(seq, uri)``: the nations of one region and the tables of one market segment."""
    n = read_table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 0).select(
        F.col("n_nationkey").cast("bigint").alias("seq"), _cat("n/", F.col("n_nationkey")).alias("uri"))
    c = read_table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("c_custkey") + 100).cast("bigint").alias("seq"), _cat("t/", F.col("c_custkey")).alias("uri"))
    return n.unionByName(c)


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of mixed commands, eleven per customer: tables registered, dropped and registered anew, concepts per
    nation that grow, are updated and lose relationships again, a rejected prefix and a rejected kind."""
    c = read_table(spark, sf_dir, "customer")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    table, concept, region = _cat("t/", k), _cat("mc/", nk), _cat("r/", k % 5)

    def command(at: int, kind: str, uri: Column, name=None, label=None, type_=None, comment=None, alts=None, predicate=None, target=None) -> Column:
        def text(x):
            return _null_s() if x is None else F.lit(x) if isinstance(x, str) else x

        return F.struct((k * 16 + at).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), uri.alias("uri"), text(name).alias("name"),
                        text(label).alias("label"), text(type_).alias("type"), text(comment).alias("comment"),
                        (_null_a() if alts is None else alts).alias("alt_labels"), text(predicate).alias("predicate_type"), text(target).alias("target_uri"))

    return _rows(
        c, command(0, "assign-concepts", table, target=region), command(1, "register-tables", table, name=_cat("again ", k)),
        command(2, "delete-objects", F.when(k % 3 == 0, table)), command(3, "register-tables", table, name=_cat("anew ", k)),
        command(4, "insert-concepts", concept, label=_cat("L", k), type_="skos_concept", comment=_cat("C", k % 3), alts=F.array(_cat("A", k % 4))),
        command(5, "update-concepts", F.when(k % 7 == 0, concept), label=_cat("U", k), comment=F.when(k % 2 == 0, ""),
                alts=F.when(k % 14 == 0, F.array(_cat("B", k)))),
        command(6, "add-relationships", concept, predicate="skos:broader", target=region),
        command(7, "delete-relationships", F.when(k % 2 == 0, concept), predicate="skos:broader", target=_cat("r/", (k + 2) % 5)),
        command(8, "assign-concepts", table, target=concept), command(9, "add-relationships", table, predicate="bad:x", target=region),
        command(10, "compact", table))


# IRIs written into the generated import file.
_SUP = "http://example.com/ontology/supplier/"
_DOC = "http://example.com/ontology/document/"
_RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_RDFS = "http://www.w3.org/2000/01/rdf-schema#"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_UC = "http://example.com/ontology/uc/"
_USER = "http://example.com/ontology/"


def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An N-Triples file (column ``value``) describing suppliers.

    Per supplier: a typed table with a name, an integer, a date and a boolean
    literal, a language-tagged label with escapes, a blank-node statement, a
    statement the derived graph already holds (for the first suppliers), a
    comment line and a malformed line. Per document: its whole text as a comment,
    with escapes and a character reference.
    """
    s = read_table(spark, sf_dir, "supplier")
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    subj = _cat("<", _SUP, k, ">")
    lines = [
        _cat(subj, " ", _RDF_TYPE, " <", _UC, "Table> ."),
        _cat(subj, " <", _UC, "name> \"main.suppliers.", F.col("s_name"), "\" ."),
        _cat(subj, " <", _USER, "nation> \"", nk, "\"^^<", _XSD, "integer> ."),
        _cat(subj, " <", _RDFS, "label> \"Supplier \\\"", k, "\\\"\\nline\"@EN ."),
        _cat("_:s", k, " <", _RDFS, "comment> \"bnode of ", k, "\" ."),
        _cat("<t/", k, "> ", _RDF_TYPE, " <", _UC, "Table> ."),
        _cat(subj, " <", _USER, "since> \"", 1990 + nk, "-01-0", 1 + nk % 9, "\"^^<", _XSD, "date> ."),
        _cat(subj, " <", _USER, "active> \"", F.when(k % 2 == 0, "true").otherwise("false"), "\"^^<", _XSD,
             "boolean> ."),
        _cat("# supplier ", k),
        _cat("supplier ", k, " is not a triple"),
    ]
    d = read_table(spark, sf_dir, "documents").filter("text is not null")
    text = F.replace(escape(F.col("text")), F.lit("\u00e9"), F.lit("\\u00E9"))
    about = d.select(_cat("<", _DOC, F.col("doc_id"), "> <", _RDFS, "comment> \"", text, "\" .").alias("value"))
    return s.select(F.explode(F.array(*lines)).alias("value")).unionByName(about)


def turtle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle files as lines ``(file, split, at, value)``, in many splits that cut statements and strings.

    A file per nation of suppliers, with abbreviated statements of many lines,
    both forms of directives, a prefix that is bound anew in the middle, an
    unnamed blank node, a statement with an unbound prefix and one that is no
    Turtle; eight files of documents, whose whole texts are long strings.
    """
    s = read_table(spark, sf_dir, "supplier")
    k, nk = F.col("s_suppkey"), F.col("s_nationkey")
    about = _cat("# supplier ", k, "; no [ statement .\n<supplier/", k, "> a uc:Table ,\n    <class/", nk, "> ;\n  uc:name \"main.suppliers.", F.col("s_name"),
                 "\" ;\n  rdfs:label \"Supplier \\\"", k, "\\\"\\nline\"@EN , 'x.y; \"z\"'@en-GB ; ;\n  user:nation ", nk, " ; user:balance ", nk,
                 ".5 ; user:active ", F.when(k % 2 == 0, "true").otherwise("false"), " ;\n  user:since \"", 1990 + nk, "-01-0", 1 + nk % 9,
                 "\"^^xsd:date ;\n  rdfs:seeAlso [ rdfs:comment \"\"\"bnode\nof ", k, "\"\"\" ] .\n<supplier/", k,
                 "> rdfs:comment nosuch:k .\nsupplier ", k, " is not a triple .")
    head = _cat("@prefix uc: <", _UC, "> .\n@prefix rdfs: <", _RDFS, ">. PREFIX xsd: <", _XSD, ">\n@prefix user: <", _USER, "> . @base <", _USER, "> .")
    again = _cat("prefix user:\n<", _USER, "other/>")
    d = read_table(spark, sf_dir, "documents").filter("text is not null")
    long = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def part(rows: DataFrame, file: Column, place, text: Column) -> DataFrame:
        return rows.select(file.alias("file"), (F.lit(place) if isinstance(place, int) else place).cast("bigint").alias("place"), text.alias("text"))

    nation, doc_file = _cat("nation-", nk), _cat("documents-", F.col("doc_id") % 8)
    parts = (part(s, nation, 2 * k, about).unionByName(part(s.select("s_nationkey").distinct(), nation, -1, head))
             .unionByName(part(s.select("s_nationkey").distinct(), nation, 2 * REBOUND + 1, again))
             .unionByName(part(d, doc_file, 2 * F.col("doc_id"), _cat("<document/", F.col("doc_id"), "> rdfs:comment\n\"\"\"", long, "\"\"\" .")))
             .unionByName(part(d.select((F.col("doc_id") % 8).alias("doc_id")).distinct(), doc_file, -1, head)))
    lines = parts.select("file", "place", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return (lines.select("file", (F.col("place") * 1024 + F.least(F.shiftright("line", 2), F.lit(1023))).alias("split"),
                         (F.col("place") * (1 << 24) + F.col("line")).alias("at"), "value")
            .repartition("file", "split").sortWithinPartitions("file", "split", "at"))


#: Suppliers of higher keys come after their file binds its prefix anew.
REBOUND = 5


def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awkward object names for IRI minting, one per customer."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        _cat(F.col("c_name"), " ", F.lower("c_mktsegment"), "/x~y*z+w%v?u=t&s#r'q(p)o!n é").alias("name"),
        F.lit("main").alias("catalog"),
        F.lower("c_mktsegment").alias("schema"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(_cat(F.col("c_name"), " (", F.col("c_nationkey"),
                                                                  ")!*'~")).alias("tbl"),
    )
