"""Data model: the triples schema, the vocabulary and graph access helpers.

A graph is a DataFrame with :data:`TRIPLE_SCHEMA` and *set* semantics (no two
rows share all six columns). Vocabulary terms are stored in compact form
(``rdf:type``); every other IRI is stored in full. Blank nodes are ``_:label``.
``o_kind`` tells IRIs, blank nodes and literals apart; a literal keeps its
lexical form in ``o`` plus optional datatype (compact, e.g. ``xsd:integer``)
and language tag.

Stored graphs are parquet partitioned by :func:`storage_key`, so that the
predicate, class or literal filter almost every operator starts with becomes
partition pruning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("s", T.StringType(), False),
        T.StructField("p", T.StringType(), False),
        T.StructField("o", T.StringType(), False),
        T.StructField("o_kind", T.StringType(), False),
        T.StructField("o_datatype", T.StringType(), True),
        T.StructField("o_lang", T.StringType(), True),
    ]
)
TRIPLE_COLUMNS = [f.name for f in TRIPLE_SCHEMA.fields]

IRI, BNODE, LIT = "iri", "bnode", "lit"

# Partition column of stored graphs.
PK = "pk"
OTHER_PARTITION = "~other"


class Vocab:
    """Compact vocabulary terms the operators read and write (fixed values)."""

    TYPE = "rdf:type"
    PROPERTY = "rdf:Property"
    LABEL = "rdfs:label"
    COMMENT = "rdfs:comment"
    CLASS = "rdfs:Class"
    SUBCLASS_OF = "rdfs:subClassOf"
    DOMAIN = "rdfs:domain"
    RANGE = "rdfs:range"
    CONCEPT = "skos:Concept"
    ALT_LABEL = "skos:altLabel"
    BROADER = "skos:broader"
    NARROWER = "skos:narrower"
    OWL_CLASS = "owl:Class"
    TABLE = "uc:Table"
    COLUMN = "uc:Column"
    NAME = "uc:name"
    CONCEPT_ASSIGNMENT = "uc:conceptAssignment"
    PROPERTY_ASSIGNMENT = "uc:propertyAssignment"

    HIERARCHY = (SUBCLASS_OF, BROADER, NARROWER)


# Namespace prefixes bound by the graph and their IRIs. The
# catalog ("uc") and user namespaces are deployment configuration; the
# defaults below are neutral placeholders.
DEFAULT_NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "uc": "http://example.com/ontology/uc/",
    "user": "http://example.com/ontology/",
}
USER_NS = DEFAULT_NAMESPACES["user"]

# Predicates that get their own storage partition; the rest share one.
KNOWN_PREDICATES = (
    Vocab.TYPE,
    Vocab.LABEL,
    Vocab.COMMENT,
    Vocab.SUBCLASS_OF,
    Vocab.DOMAIN,
    Vocab.RANGE,
    Vocab.ALT_LABEL,
    Vocab.BROADER,
    Vocab.NARROWER,
    Vocab.NAME,
    Vocab.CONCEPT_ASSIGNMENT,
    Vocab.PROPERTY_ASSIGNMENT,
)


# Classes whose rdf:type rows get their own storage partition, so ontology look-ups
# never read the type rows of catalog objects.
KNOWN_CLASSES = (Vocab.CLASS, Vocab.CONCEPT, Vocab.PROPERTY, Vocab.OWL_CLASS, Vocab.TABLE, Vocab.COLUMN)
CATALOG_CLASSES = (Vocab.TABLE, Vocab.COLUMN)
LITERALS = "~lit"


def storage_key(p: Column, o: Column, o_kind: Column) -> Column:
    """Partition of a triple: its predicate if known, split by class for types and by literal objects."""
    base = F.when(p.isin(*KNOWN_PREDICATES), p).otherwise(F.lit(OTHER_PARTITION))
    return (F.when(o_kind == LIT, F.concat(base, F.lit(LITERALS)))
            .when((p == Vocab.TYPE) & (o_kind == IRI) & o.isin(*KNOWN_CLASSES), F.concat(p, F.lit("|"), o)).otherwise(base))


def class_key(cls: str) -> str:
    return f"{Vocab.TYPE}|{cls}" if cls in KNOWN_CLASSES else Vocab.TYPE


def storage_keys(preds, classes=KNOWN_CLASSES) -> list[str]:
    """The partitions that hold triples of ``preds`` (for types: of unknown classes and ``classes``)."""
    bases = {p if p in KNOWN_PREDICATES else OTHER_PARTITION for p in preds}
    typed = {class_key(c) for c in classes} if Vocab.TYPE in preds else set()
    return sorted(bases | {b + LITERALS for b in bases} | typed)


def empty_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLE_SCHEMA)


def triples(s: Column, p: Column | str, o: Column, kind: str, datatype: Column | None = None,
            lang: Column | None = None) -> list[Column]:
    """Columns of a triple, for ``select``."""
    pc = F.lit(p) if isinstance(p, str) else p
    return [
        s.alias("s"),
        pc.alias("p"),
        o.alias("o"),
        F.lit(kind).alias("o_kind"),
        (datatype if datatype is not None else F.lit(None).cast("string")).alias("o_datatype"),
        (lang if lang is not None else F.lit(None).cast("string")).alias("o_lang"),
    ]


# ---------------------------------------------------------------------------
# Pattern helpers. Each one is a predicate scan; on a stored graph the
# ``pk`` filter prunes partitions, on an in-memory graph it is a plain filter.
# ---------------------------------------------------------------------------


def by_predicate(g: DataFrame, *preds: str) -> DataFrame:
    """Triples whose predicate is one of ``preds`` (``FILTER(?p IN (...))``)."""
    if PK in g.columns:
        g = g.filter(F.col(PK).isin(*storage_keys(preds)))
    cond = F.col("p") == preds[0] if len(preds) == 1 else F.col("p").isin(*preds)
    return g.filter(cond)


def literals(g: DataFrame) -> DataFrame:
    """Triples with a literal object."""
    if PK in g.columns:
        g = g.filter(F.col(PK).isin(*[k + LITERALS for k in (*KNOWN_PREDICATES, OTHER_PARTITION)]))
    return g.filter(F.col("o_kind") == LIT)


def edges(g: DataFrame, pred: str, src: str, dst: str) -> DataFrame:
    """``?src pred ?dst`` as ``(src, dst)`` (any object kind)."""
    return by_predicate(g, pred).select(F.col("s").alias(src), F.col("o").alias(dst))


def instances(g: DataFrame, cls: str, col: str = "uri") -> DataFrame:
    """Subjects of ``?x rdf:type cls``; one row per subject (graphs are sets)."""
    if PK in g.columns:
        g = g.filter(F.col(PK) == class_key(cls))
    return (
        g.filter((F.col("p") == Vocab.TYPE) & (F.col("o") == cls) & (F.col("o_kind") == IRI))
        .select(F.col("s").alias(col))
    )


def values(g: DataFrame, pred: str, subj: str, val: str) -> DataFrame:
    """``?subj pred ?val`` as strings (labels, names, comments)."""
    return by_predicate(g, pred).select(F.col("s").alias(subj), F.col("o").alias(val))
