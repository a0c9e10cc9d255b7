"""Test inputs derived from the driver's TPC-H-style tables.

``derived_graph`` turns region/nation/part/orders/customer rows into a triples
graph holding an ontology (regions and nations as classes, part types as SKOS
concepts, order priorities as properties) and a catalog (customers as tables,
orders as columns) with assignments between them. ``current_tags`` builds the
tags "already on" those catalog objects from lineitem joins. Both definitions
are fixed by FIXTURES.md; the same rows are produced by the SQL in
:mod:`ontocat.plans.oracle`.

Each source table is scanned once: a row emits all of its triples through one
``inline`` of an array of conditional structs, rather than one scan per
triple pattern. Ontology triples that repeat per row (priorities, part types)
are emitted from the distinct driving values, so the final set dedupe only
sees catalog-sized input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontocat.model import IRI, LIT, TRIPLE_COLUMNS, Vocab

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _t(s: Column, p: str, o: Column, kind: str, when: Column | None = None) -> Column:
    st = F.struct(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"),
                  F.lit(kind).alias("o_kind"))
    return st if when is None else F.when(when, st)


def _emit(df: DataFrame, *items: Column) -> DataFrame:
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    return (
        df.select(F.inline(arr))
        .withColumn("o_datatype", F.lit(None).cast("string"))
        .withColumn("o_lang", F.lit(None).cast("string"))
        .select(*TRIPLE_COLUMNS)
    )


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def table_entity_name(segment: Column, cname: Column) -> Column:
    """Catalog name of the table standing for one customer."""
    return _cat("main.", F.lower(segment), ".", F.regexp_replace(cname, "#", "_"))


def derived_graph(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """The derived triples graph; ``distinct=False`` leaves the set dedupe to the writer."""
    V = Vocab
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    part = read_table(spark, sf_dir, "part")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")

    r = _emit(
        region,
        _t(_cat("r/", F.col("r_regionkey")), V.TYPE, F.lit(V.CLASS), IRI),
        _t(_cat("r/", F.col("r_regionkey")), V.LABEL, F.col("r_name"), LIT),
    )

    nk = F.col("n_nationkey")
    ns = _cat("n/", nk)
    n = _emit(
        nation,
        _t(ns, V.SUBCLASS_OF,
           F.when(nk % 11 == 10, F.lit("gone/1")).otherwise(_cat("r/", F.col("n_regionkey"))), IRI),
        _t(ns, V.TYPE, F.lit(V.CLASS), IRI, nk % 2 == 0),
        _t(ns, V.BROADER, _cat("r/", F.col("n_regionkey")), IRI, nk % 3 == 0),
        _t(ns, V.LABEL, F.col("n_name"), LIT, nk % 7 != 6),
        _t(ns, V.COMMENT, _cat("Nation ", F.col("n_name")), LIT),
        _t(ns, V.ALT_LABEL, F.lower(F.col("n_name")), LIT, nk % 5 == 0),
        _t(ns, V.ALT_LABEL, _cat("alt ", F.col("n_name")), LIT, nk % 10 == 0),
    )

    types_brands = part.select("p_type", F.regexp_replace("p_brand", "#", "").alias("b"), "p_brand").distinct()
    ty = _cat("ty/", F.col("p_type"))
    br = _cat("b/", F.col("b"))
    pt = _emit(
        types_brands,
        _t(ty, V.TYPE, F.lit(V.CONCEPT), IRI),
        _t(ty, V.LABEL, F.col("p_type"), LIT),
        _t(ty, V.NARROWER, br, IRI),
        _t(br, V.TYPE, F.lit(V.OWL_CLASS), IRI),
        _t(br, V.LABEL, F.col("p_brand"), LIT),
    )

    # An ontology that grows with the tables: a concept per part, a property per supplier,
    # one concept with a synonym per customer and one assigned to a third of the tables.
    pk = F.col("p_partkey")
    px = _cat("pt/", pk)
    parts = _emit(
        part,
        _t(px, V.TYPE, F.lit(V.CONCEPT), IRI),
        _t(px, V.LABEL, F.col("p_name"), LIT, pk % 17 != 16),
        _t(px, V.BROADER, ty, IRI),
        _t(px, V.ALT_LABEL, _cat(F.col("p_name"), " ", F.col("p_brand")), LIT, pk % 3 == 0),
    )
    supplier = read_table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    sx = _cat("sp/", sk)
    suppliers = _emit(
        supplier,
        _t(sx, V.TYPE, F.lit(V.PROPERTY), IRI),
        _t(sx, V.LABEL, F.col("s_name"), LIT),
        _t(sx, V.DOMAIN, _cat("pt/", sk), IRI),
        _t(sx, V.RANGE, _cat("n/", F.col("s_nationkey")), IRI, sk % 2 == 0),
        _t(sx, V.ALT_LABEL, F.lower(F.col("s_name")), LIT, sk % 5 != 0),
    )

    prio = orders.select("o_orderpriority").distinct()
    pc = F.substring("o_orderpriority", 1, 1)
    pr = _cat("pr/", pc)
    pp = _emit(
        prio,
        _t(pr, V.TYPE, F.lit(V.PROPERTY), IRI),
        _t(pr, V.LABEL, F.col("o_orderpriority"), LIT),
        _t(pr, V.ALT_LABEL, F.lower(F.col("o_orderpriority")), LIT, pc != "5"),
        _t(pr, V.DOMAIN, F.when(pc == "5", F.lit("n/6")).otherwise(_cat("r/", pc)), IRI),
        _t(pr, V.RANGE, _cat("n/", pc), IRI, pc.isin("1", "2")),
    )

    ck = F.col("c_custkey")
    ts = _cat("t/", ck)
    c = _emit(
        customer,
        _t(ts, V.TYPE, F.lit(V.TABLE), IRI),
        _t(ts, V.NAME, table_entity_name(F.col("c_mktsegment"), F.col("c_name")), LIT, ck % 50 != 49),
        _t(ts, V.CONCEPT_ASSIGNMENT, _cat("n/", F.col("c_nationkey")), IRI),
        _t(ts, V.CONCEPT_ASSIGNMENT, F.lit("ty/PROMO"), IRI, ck % 4 == 0),
        _t(ts, V.CONCEPT_ASSIGNMENT, F.lit("gone/2"), IRI, ck % 97 == 0),
        _t(ts, V.CONCEPT_ASSIGNMENT, F.lit("pt/1"), IRI, ck % 3 == 0),
        _t(F.lit("r/0"), V.ALT_LABEL, _cat("syn ", F.col("c_name")), LIT),
    )

    ok = F.col("o_orderkey")
    cs = _cat("c/", ok)
    o = _emit(
        orders,
        _t(cs, V.TYPE, F.lit(V.COLUMN), IRI, ok % 13 != 12),
        _t(cs, V.PROPERTY_ASSIGNMENT, pr, IRI),
    )
    # Column names need the owning customer: one equi-join on the customer key.
    named = orders.filter(ok % 29 != 28).select("o_orderkey", "o_custkey").join(
        customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_name"), "o_custkey"
    )
    on = _emit(
        named,
        _t(cs, V.NAME, _cat(table_entity_name(F.col("c_mktsegment"), F.col("c_name")), ".o", ok), LIT),
    )

    raw = r.unionByName(n).unionByName(pt).unionByName(parts).unionByName(suppliers).unionByName(pp).unionByName(c).unionByName(o).unionByName(on)
    return raw.distinct() if distinct else raw


def current_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``current_tags(entity_type, entity_name, tag_key)`` — tags on catalog objects now."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")

    # Lineitem is the big side: one join to orders maps each line to its
    # customer, then (customer, supplier) and (customer, part) pairs are
    # deduplicated (map-side partial aggregation) before the small dimension
    # joins, which AQE turns into broadcasts when they are small.
    lines = li.join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey"
    )
    tname = table_entity_name(F.col("c_mktsegment"), F.col("c_name"))
    by_nation = (
        lines.select("c_custkey", "l_suppkey").distinct()
        .join(supplier.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")
        .join(nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
        .select("c_custkey", "n_name").distinct()
        .join(customer, "c_custkey")
        .select(F.lit("tables").alias("entity_type"), tname.alias("entity_name"),
                _cat("TYPE_", F.col("n_name")).alias("tag_key"))
    )
    by_brand = (
        lines.select("c_custkey", "l_partkey").distinct()
        .join(part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
        .select("c_custkey", "p_brand").distinct()
        .join(customer, "c_custkey")
        .select(F.lit("tables").alias("entity_type"), tname.alias("entity_name"),
                _cat("BRAND_", F.col("p_brand")).alias("tag_key"))
    )
    ocol = orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(
        customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    )
    ok = F.col("o_orderkey")
    cname = _cat(tname, ".o", ok)
    col_tags = ocol.select(
        F.inline(
            F.filter(
                F.array(
                    F.when(ok % 2 == 0, F.struct(cname.alias("entity_name"),
                                                 _cat("TYPE_", F.col("o_orderpriority")).alias("tag_key"))),
                    F.when(ok % 3 == 0, F.struct(cname.alias("entity_name"), F.lit("TYPE_OLD").alias("tag_key"))),
                    F.when(ok % 5 == 0, F.struct(cname.alias("entity_name"), F.lit("TYPEX").alias("tag_key"))),
                ),
                lambda x: x.isNotNull(),
            )
        )
    ).select(F.lit("columns").alias("entity_type"), "entity_name", "tag_key")
    return by_nation.unionByName(by_brand).unionByName(col_tags).distinct()
