"""Line-oriented graph import (S2) and export (S3) in N-Triples.

N-Triples is the line-per-statement subset of Turtle, so a graph file is read
with ``spark.read.text`` and parsed with ``regexp_extract`` on each line in
parallel; no file has to pass through one process. Export is the reverse: one
``concat`` per triple, written with ``DataFrame.write.text``.

Stored form: vocabulary IRIs compact (``rdf:type``), other IRIs in full,
blank nodes ``_:label``. Blank-node labels are scoped to one import: they are
re-labelled with the batch id, so importing the same file twice adds its
blank-node triples twice (fresh nodes each time), as a graph store does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontocat.functions.scalars import export_form, store_form
from ontocat.model import BNODE, IRI, LIT, TRIPLE_COLUMNS, TRIPLE_SCHEMA
from ontocat.operators.mutations import triples_not_in
from ontocat.session import new_snapshot_path

_IRI = r"<[^>]*>"
_BNODE = r"_:[A-Za-z0-9_][A-Za-z0-9_.\-]*"
# Possessive, so that a literal of any length is matched without recursion or backtracking.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_LITERAL = _QUOTED.replace("(", "(?:", 1) + r'(?:\^\^<[^>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
STATEMENT = rf"^\s*({_IRI}|{_BNODE})\s+({_IRI})\s+({_IRI}|{_BNODE}|{_LITERAL})\s*\.\s*(?:#.*)?$"
SKIP = r"^\s*(#.*)?$"
MARK = "\u0001"

# A text as pieces: plain text, a run of \\uXXXX (UTF-16 units, so that surrogate pairs stay together), one
# \\UXXXXXXXX, or a backslash with the character it escapes.
_PIECES = r"(?s)[^\\]++|(?:\\u[0-9A-Fa-f]{4})++|\\U[0-9A-Fa-f]{8}|\\."
# Surrogates without their other half; they stand for no character.
_LONE = (r"\\u[dD][89abAB][0-9A-Fa-f]{2}(?!\\u[dD][c-fC-F][0-9A-Fa-f]{2})"
         r"|(?<!\\u[dD][89abAB][0-9A-Fa-f]{2})\\u[dD][c-fC-F][0-9A-Fa-f]{2}")
# What the escaped characters stand for.
ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def unescape(x: Column) -> Column:
    """Decode N-Triples string escapes: ``\\\\ \\" \\n \\r \\t \\b \\f`` and ``\\uXXXX`` / ``\\UXXXXXXXX``.

    Every piece is decoded on its own, so no decoded text is read as an escape
    again. Code points that do not exist become U+FFFD.
    """
    return F.when(F.contains(x, F.lit("\\")), F.array_join(F.transform(
        F.regexp_extract_all(x, F.lit(_PIECES), F.lit(0)), _decoded), "")).otherwise(x)


def _decoded(piece: Column) -> Column:
    second = F.substring(piece, 2, 1)
    utf16 = F.regexp_replace(F.regexp_replace(piece, _LONE, r"\\uFFFD"), r"\\u", "")
    digits = F.upper(F.substring(piece, 3, 8))
    exists = (digits <= "0010FFFF") & ~digits.between("0000D800", "0000DFFF")
    out = (F.when(~F.startswith(piece, F.lit("\\")), piece)
           .when((second == "u") & (F.length(piece) >= 6), F.decode(F.unhex(utf16), "UTF-16BE"))
           .when((second == "U") & (F.length(piece) == 10),
                 F.decode(F.unhex(F.when(exists, digits).otherwise("0000FFFD")), "UTF-32")))
    for letter, char in ESCAPED.items():
        out = out.when(second == letter, F.lit(char))
    return out.otherwise(F.substring(piece, 2, 2))


# Characters N-Triples does not allow inside <IRI>, written as \uXXXX.
IRI_FORBIDDEN = ("\\", " ", "<", ">", '"', "{", "}", "|", "^", "`")


def escape_iri(x: Column) -> Column:
    """IRI text for ``<...>``: forbidden characters become ``\\uXXXX`` escapes (backslash first)."""
    e = x
    for ch in IRI_FORBIDDEN:
        e = F.replace(e, F.lit(ch), F.lit("\\u%04X" % ord(ch)))
    return F.when(x.rlike("[" + re.escape("".join(IRI_FORBIDDEN)) + "]"), e).otherwise(x)


def unescape_iri(x: Column) -> Column:
    """Decode ``\\uXXXX`` / ``\\UXXXXXXXX`` escapes inside an IRI."""
    return unescape(x)


def escape(x: Column) -> Column:
    """Inverse of :func:`unescape` for the characters export has to escape."""
    e = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for ch, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        e = F.replace(e, F.lit(ch), F.lit(esc))
    return F.when(x.rlike(r'["\\\n\r]'), e).otherwise(x)


def _matched(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines with their statement's three terms, each behind a mark that no line of a statement starts with.

    The generator is a border that the optimiser does not merge projections
    across, so the statement is matched once per line.
    """
    marked = F.regexp_replace(F.col("value"), STATEMENT, MARK + "$1" + MARK + "$2" + MARK + "$3")
    statement = F.startswith(F.col("marked"), F.lit(MARK)) & ~F.startswith(F.col("value"), F.lit(MARK))
    return lines.select("value", F.explode(F.array(marked)).alias("marked")), F.coalesce(statement, F.lit(False))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The non-empty, non-comment lines of ``lines`` that are no statement (``value``)."""
    m, statement = _matched(lines)
    return m.filter(~statement & ~F.col("value").rlike(SKIP)).select("value")


def parse_lines(lines: DataFrame, batch_id: str | None = None, namespaces=None) -> tuple[DataFrame, DataFrame]:
    """Parse a ``value`` column of N-Triples lines.

    Returns ``(triples, rejects)``: distinct triples in stored form, and the
    non-empty, non-comment lines that are not a statement (``value``).
    Decoding happens in its own projection, before the namespace compaction
    that references each term several times, so every term is decoded once.
    """
    m, statement = _matched(lines)
    m = m.filter(statement).select(F.explode(F.array(F.split("marked", MARK, 4))).alias("terms"))
    m = m.select(*[F.col("terms")[i + 1].alias(n) for i, n in enumerate(("ts", "tp", "to"))])
    return decode_terms(m, batch_id, namespaces), rejected_lines(lines)


def decode_terms(m: DataFrame, batch_id: str | None = None, namespaces=None) -> DataFrame:
    """Distinct triples in stored form from N-Triples terms in the columns ``ts``, ``tp`` and ``to``."""
    def iri_of(tok: str) -> Column:
        return unescape_iri(F.regexp_extract(F.col(tok), r"^<(.*)>$", 1))

    def bnode_of(tok: str) -> Column:
        t = F.col(tok)
        return F.concat(F.lit(f"_:{batch_id}_"), F.substring(t, 3, 1 << 30)) if batch_id else t

    o_tok = F.col("to")
    decoded = m.select(
        F.startswith(F.col("ts"), F.lit("_:")).alias("s_bnode"),
        iri_of("ts").alias("s_iri"), bnode_of("ts").alias("s_b"),
        iri_of("tp").alias("p_iri"),
        F.when(F.startswith(o_tok, F.lit('"')), F.lit(LIT))
        .when(F.startswith(o_tok, F.lit("_:")), F.lit(BNODE)).otherwise(F.lit(IRI)).alias("o_kind"),
        iri_of("to").alias("o_iri"), bnode_of("to").alias("o_b"),
        unescape(F.regexp_extract(o_tok, '^' + _QUOTED, 1)).alias("lexical"),
        F.when(F.endswith(o_tok, F.lit(">")), F.substring_index(F.rtrim(o_tok, F.lit(">")), "^^<", -1)).otherwise("").alias("dt"),
        F.when(F.startswith(o_tok, F.lit('"')) & ~F.endswith(o_tok, F.lit('"')),
               F.regexp_extract(F.substring_index(o_tok, '"', -1), r'^@([A-Za-z]+(?:-[A-Za-z0-9]+)*)$', 1)).otherwise("").alias("lang"),
    )
    k = F.col("o_kind")
    triples = decoded.select(
        F.when(F.col("s_bnode"), F.col("s_b")).otherwise(store_form(F.col("s_iri"), namespaces)).alias("s"),
        store_form(F.col("p_iri"), namespaces).alias("p"),
        F.when(k == LIT, F.col("lexical")).when(k == BNODE, F.col("o_b"))
        .otherwise(store_form(F.col("o_iri"), namespaces)).alias("o"),
        k.alias("o_kind"),
        F.when((k == LIT) & (F.col("dt") != ""), store_form(F.col("dt"), namespaces)).alias("o_datatype"),
        F.when((k == LIT) & (F.col("lang") != ""), F.lower(F.col("lang"))).alias("o_lang"),
    ).distinct()
    return triples


def import_merge(g: DataFrame, lines: DataFrame, batch_id: str, namespaces=None
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set-union the parsed lines into ``g``.

    Returns ``(merged_graph, added, rejects)``; ``added`` holds the triples that
    were not in ``g`` (its row count is the reference's "triples imported").
    The parsed triples are written to the shared folder first, so the lines are
    parsed once, however often the merge reads them.
    """
    parsed, rejects = parse_lines(lines, batch_id, namespaces)
    return merge_parsed(g, parsed) + (rejects,)


def merge_parsed(g: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(merged_graph, added)`` of a graph and triples from a parser, which runs once."""
    spark = g.sparkSession
    path = new_snapshot_path(spark, "parsed")
    parsed.write.parquet(path)
    added = triples_not_in(g, spark.read.schema(TRIPLE_SCHEMA).parquet(path))
    return g.select(*TRIPLE_COLUMNS).unionByName(added), added


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or more N-Triples files (a directory or glob works too)."""
    return spark.read.text(path)


def export_lines(g: DataFrame, namespaces=None) -> DataFrame:
    """S3: one N-Triples statement per triple, column ``value``."""
    def ref(term: Column, kind: Column) -> Column:
        return F.when(kind == BNODE, term).otherwise(
            F.concat(F.lit("<"), escape_iri(export_form(term, namespaces)), F.lit(">")))

    s_kind = F.when(F.startswith(F.col("s"), F.lit("_:")), F.lit(BNODE)).otherwise(F.lit(IRI))
    lit = F.concat(
        F.lit('"'), escape(F.col("o")), F.lit('"'),
        F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
        .when(F.col("o_datatype").isNotNull(),
              F.concat(F.lit("^^<"), export_form(F.col("o_datatype"), namespaces), F.lit(">")))
        .otherwise(F.lit("")),
    )
    obj = F.when(F.col("o_kind") == LIT, lit).otherwise(ref(F.col("o"), F.col("o_kind")))
    return g.select(F.concat_ws(" ", ref(F.col("s"), s_kind), ref(F.col("p"), F.lit(IRI)), obj, F.lit(".")).alias(
        "value"))


def export_graph(g: DataFrame, path: str, namespaces=None) -> str:
    """Write the graph as N-Triples text files under ``path``."""
    export_lines(g, namespaces).write.mode("errorifexists").text(path)
    return path
