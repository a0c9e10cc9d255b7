"""Turtle export (S3): triples grouped by subject and predicate, in files that each stand alone.

The rows are range-partitioned and sorted by (subject, type first, predicate,
object); a subject with very many triples lies in several partitions and is
taken up again in each. Terms become text as columns; a task only compares each
row with the one before it to tell ``,`` from ``;`` from ``.``, holding one row
back, so a group may be of any size and cross batches freely. A statement ends
after :data:`STATEMENT_ROWS` triples, since a reader holds one whole; the
subject is taken up again in the next. Every partition is one file with its own
directives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontocat.functions.scalars import VOCAB_PREFIXES, compact_iri, export_form
from ontocat.model import BNODE, DEFAULT_NAMESPACES, LIT, Vocab
from ontocat.session import ship_package
from ontocat.sources.ntriples import escape, escape_iri

#: Local names that need no escape in Turtle; other IRIs are written in full.
PLAIN_LOCAL = r"[A-Za-z_][A-Za-z0-9_\-]*$"
#: Most triples of one statement.
STATEMENT_ROWS = 1_000
#: How far a line is set in, by the mark before it.
_INDENT = {",": "        ", ";": "    "}


def _iri(term: Column, namespaces: dict[str, str]) -> Column:
    """An IRI in stored form as a prefixed name where its local part is plain, else in full."""
    stored = [p for p in sorted(namespaces) if p in VOCAB_PREFIXES]
    others = tuple(p for p in namespaces if p not in VOCAB_PREFIXES)
    short = compact_iri(term, namespaces, others)  # terms of the vocabulary are stored as names
    return (F.when(term.rlike(f"^({'|'.join(stored)}):{PLAIN_LOCAL}"), term)
            .when(short.rlike("^[^:]*:" + PLAIN_LOCAL), short)
            .otherwise(F.concat(F.lit("<"), escape_iri(export_form(term, namespaces)), F.lit(">"))))


def turtle_terms(g: DataFrame, namespaces: dict[str, str] | None = None) -> DataFrame:
    """``(s, p, o)`` as Turtle terms, ``a`` for the type."""
    ns = namespaces or DEFAULT_NAMESPACES
    s = F.when(F.startswith("s", F.lit("_:")), F.col("s")).otherwise(_iri(F.col("s"), ns))
    p = F.when(F.col("p") == Vocab.TYPE, F.lit("a")).otherwise(_iri(F.col("p"), ns))
    tail = (F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
            .when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^"), _iri(F.col("o_datatype"), ns))).otherwise(F.lit("")))
    o = (F.when(F.col("o_kind") == LIT, F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), tail))
         .when(F.col("o_kind") == BNODE, F.col("o")).otherwise(_iri(F.col("o"), ns)))
    return g.select(s.alias("s"), p.alias("p"), o.alias("o"))


def _grouped(header: list[str], most: int):
    """Lines of sorted terms; a line's mark is known when the next row is seen, so one row is held back."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject = predicate = held = None
        place = 0  # of the last row among those of its subject
        first = list(header)
        for batch in batches:
            if not batch.num_rows:
                continue
            s, p, o = (pc.fill_null(c.cast(pa.string()), "None") for c in batch.columns)
            other, moved = _changes(s, subject), _changes(p, predicate)
            rows = np.arange(len(s))
            begun = np.maximum.accumulate(np.where(other, rows, -1))
            places = rows - np.where(begun < 0, -1 - place, begun)
            opens = places % most == 0
            mark = pc.if_else(pa.array(opens), ".", pc.if_else(pa.array(moved), ";", ","))
            pair = pc.binary_join_element_wise(p, o, " ")
            text = pc.if_else(pa.array(opens), pc.binary_join_element_wise(s, pair, " "), pc.if_else(
                pa.array(moved), pc.binary_join_element_wise(_INDENT[";"], pair, ""), pc.binary_join_element_wise(_INDENT[","], o, "")))
            before = text.slice(0, len(s) - 1) if held is None else pa.concat_arrays([pa.array([held], pa.string()), text.slice(0, len(s) - 1)])
            ended = pc.binary_join_element_wise(before, mark.slice(len(s) - len(before)), " ")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(first, pa.string()), ended])], ["value"])
            subject, predicate, held, place, first = s[-1].as_py(), p[-1].as_py(), text[-1].as_py(), int(places[-1]), []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{held} ."])], ["value"])

    return lines


def _changes(terms: pa.Array, last: str | None) -> np.ndarray:
    """Whether each term is another than that before it, ``last`` before the first."""
    return np.concatenate([[terms[0].as_py() != last], pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)])


def turtle_lines(g: DataFrame, base: str | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """Lines ``(value)`` of the graph as Turtle; each partition is a whole document.

    ``base`` goes into the directives, for a graph with relative IRIs, which no
    reader takes without one. An empty graph gives no lines.
    """
    ship_package(g.sparkSession)
    header = [f"@base <{base}> ."] if base else []
    header += [f"@prefix {p}: <{iri}> ." for p, iri in sorted((namespaces or DEFAULT_NAMESPACES).items())]
    # Ordered as stored: terms are made once, behind the shuffle and the sampling before it.
    order = [F.col("s"), (F.col("p") != Vocab.TYPE), F.col("p"), F.col("o")]
    ranged = g.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").repartitionByRange(*order).sortWithinPartitions(*order)
    return turtle_terms(ranged, namespaces).mapInArrow(_grouped(header, STATEMENT_ROWS), "value string")


def export_turtle(g: DataFrame, path: str, base: str | None = None, namespaces: dict[str, str] | None = None) -> str:
    """Write the graph as Turtle files under ``path``, a file per partition; read them back with ``parts=True``."""
    turtle_lines(g, base, namespaces).write.mode("errorifexists").option("maxRecordsPerFile", 0).text(path)
    return path
