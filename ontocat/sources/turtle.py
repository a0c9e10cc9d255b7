"""Turtle import (S2): statements found across lines and file splits, then expanded to triples.

A Turtle statement may run over many lines, and a line, a string or a statement
may be cut by a split of the file. No file passes through one task:

1. Each split is summarised by what it does to every state that the text before
   it can end in (:data:`STATES`); summaries of a file compose, which tells the
   state that every split starts in. Ranges of splits are composed first, then
   the ranges of a file, so a file may have any number of splits.
2. With that, each split cuts itself into statements. Only the piece before its
   first statement end and the one after its last are shuffled, to be joined
   with those of its neighbours.
3. ``@prefix`` and ``@base`` bind names for the statements behind them, until
   they are bound again: statements meet bindings in a join on file and name
   with the interval in which the binding holds.
4. A statement is expanded (``;`` ``,`` ``[ ]`` ``( )``) into N-Triples terms,
   which go the same way as those of N-Triples lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontocat.operators.joins import broadcast_if_bounded
from ontocat.session import drop_snapshot, freed_shuffles, new_snapshot_path, ship_package
from ontocat.sources.ntriples import decode_terms, merge_parsed

#: What the text before a line can end in: between statements, in one, in a long string of either quote,
#: in a directive without full stop (``PREFIX``, ``BASE``), which its IRI ends.
STATES = BETWEEN, INSIDE, LONG_DOUBLE, LONG_SINGLE, DIRECTIVE = range(5)

_LONG = {LONG_DOUBLE: '"""', LONG_SINGLE: "'''"}
_LONG_END = {state: re.compile(r"(?:[^\\%s]|\\.|\\$|%s(?!%s))*+%s" % (q[0], q[0], q[:2], q), re.DOTALL) for state, q in _LONG.items()}
_LONG_REST = re.compile(r'"""|' + "'''")
_ESC = r"\\[_~.\-!$&'()*+,;=/?#@%]|%[0-9A-Fa-f]{2}"
#: Terms and marks of Turtle; ``bad`` is any character that begins none, and the reason to reject its statement.
TOKEN = re.compile(r"""
  (?P<space>\s+|\#[^\n]*)
 |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
 |(?P<long>\"{3}|'{3})
 |(?P<string>"(?:[^"\\\n\r]|\\.)*+"|'(?:[^'\\\n\r]|\\.)*+')
 |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
 |(?P<number>[+-]?(?:[0-9]+\.?[0-9]*[eE][+-]?[0-9]+|\.[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
 |(?P<bnode>_:\w(?:[\w.\-\u00b7]*[\w\-\u00b7])?)
 |(?P<name>(?:[^\W\d_](?:[\w.\-\u00b7]*[\w\-\u00b7])?)?:(?:(?:[\w:]|%(esc)s)(?:(?:[\w:.\-\u00b7]|%(esc)s)*(?:[\w:\-\u00b7]|%(esc)s))?)?)
 |(?P<word>[A-Za-z]+)
 |(?P<mark>\^\^|[.;,\[\]()])
 |(?P<bad>.)
""" .replace("%(esc)s", _ESC), re.VERBOSE | re.DOTALL)

#: Terms and marks that leave a statement open, as many as follow each other; each is just what TOKEN finds at its place.
_PLAIN = re.compile(r"""(?:\s++|<[^\x00-\x20<>"{}|^`\\]*+>|"(?!"")(?:[^"\\\n\r]|\\.)*+"|[A-Za-z]++:[A-Za-z0-9_]++(?=\s)|[^\W\d_]++(?![\w\-\u00b7:]|\.[\w.\-\u00b7:])|[;,\[\]()])++""", re.DOTALL)

_ABSOLUTE = re.compile(r"<[A-Za-z][A-Za-z0-9+.\-]*:")
#: A relative IRI of path segments that stand for themselves: behind a base's last slash it is resolved.
_BELOW = re.compile(r"<(\w[\w\-]*+(?:/\w[\w\-]*+)*+)>", re.ASCII)

# Most statements have terms of a few forms, with white space behind names and literals; what they match is just what TOKEN
# and :func:`expand` make of it. Others (and all with comments, ``[ ]``, ``( )``, numbers or long strings) go the general way.
_SIMPLE_IRI, _SIMPLE_NAME, _SIMPLE_BNODE = r"""<[^\x00-\x20<>"{}|^`\\]*+>""", r"[A-Za-z]++:[A-Za-z0-9_]++(?=\s)", r"_:[A-Za-z0-9]++(?=\s)"
_SIMPLE_STRING = rf"""\"(?!"")(?:[^"\\\n\r]|\\.)*+\"(?:@[A-Za-z]++(?:-[A-Za-z0-9]++)*+|\^\^(?:{_SIMPLE_IRI}|{_SIMPLE_NAME}))?+(?=\s)"""
_SIMPLE_NODE = f"(?:{_SIMPLE_IRI}|{_SIMPLE_NAME}|{_SIMPLE_BNODE})"
_SIMPLE_PAIR = rf"(?:a(?=\s)|{_SIMPLE_IRI}|{_SIMPLE_NAME})\s++(?:{_SIMPLE_NODE}|{_SIMPLE_STRING})"
_SIMPLE = re.compile(rf"\s*+{_SIMPLE_NODE}\s++{_SIMPLE_PAIR}(?:\s*+(?:;\s*+{_SIMPLE_PAIR}|,\s*+(?:{_SIMPLE_NODE}|{_SIMPLE_STRING})))*+\s*+\.\s*+", re.DOTALL)
_SIMPLE_ITEM = re.compile(rf"{_SIMPLE_IRI}|{_SIMPLE_STRING}|[;,.]|[A-Za-z0-9_:]++", re.DOTALL)
#: IRIs whose terms are kept at hand.
_KNOWN_TERMS = 4_096

# Terms that Turtle abbreviates.
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XSD = "http://www.w3.org/2001/XMLSchema#"


def advance(state: int, line: str) -> tuple[int, list[int]]:
    """The state behind a line that starts in ``state``, and the places in it where statements end."""
    at, ends = 0, []
    if state == BETWEEN and line.startswith("<"):  # no directive begins so
        state = INSIDE
    if state == INSIDE and (m := _PLAIN.match(line, at)):
        at = m.end()
        if at == len(line) - 1 and line[at] == ".":
            return BETWEEN, [len(line)]
    while at < len(line):
        if state in _LONG:
            m = line.find(_LONG[state], at) >= 0 and _LONG_END[state].match(line, at)
            if not m:
                return state, ends
            at, state = m.end(), INSIDE
            continue
        if state == INSIDE and (m := _PLAIN.match(line, at)):
            at = m.end()
            continue
        m = TOKEN.match(line, at)
        kind, at = m.lastgroup, m.end()
        if kind == "long":
            state = LONG_DOUBLE if m.group() == '"""' else LONG_SINGLE
        elif kind == "mark" and m.group() == "." or kind == "iri" and state == DIRECTIVE:
            ends.append(at)
            state = BETWEEN
        elif kind == "word" and state == BETWEEN and m.group().upper() in ("PREFIX", "BASE"):
            state = DIRECTIVE
        elif kind != "space" and state == BETWEEN:
            state = INSIDE
    return state, ends


class Rejected(ValueError):
    """A statement that is no Turtle."""


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, value, at = m.lastgroup, m.group(), m.end()
        if kind == "long":
            state = LONG_DOUBLE if value == '"""' else LONG_SINGLE
            end = _LONG_END[state].match(text, at)
            if not end:
                raise Rejected("string without end")
            yield "string", value + text[at:end.end()]
            at = end.end()
        elif kind == "bad":
            raise Rejected(value)
        elif kind != "space":
            yield kind, value


def _quoted(token: str) -> str:
    """A string of any quotes as an N-Triples string."""
    cut = 3 if token[:3] in ('"""', "'''") and len(token) >= 6 else 1
    raw = {'"': '\\"', "\n": "\\n", "\r": "\\r"}
    return '"' + re.sub(r'(?s)\\.|["\n\r]', lambda m: raw.get(m.group(), m.group()), token[cut:-cut]) + '"'


def _resolved(base: str | None, value: str) -> str:
    """``<IRI>`` in full."""
    if _ABSOLUTE.match(value):
        return value
    if base is None:
        raise Rejected("relative IRI without base")
    if m := _BELOW.fullmatch(value):
        return f"<{_below(base)}{m.group(1)}>"
    return f"<{urljoin(base, value[1:-1])}>"


@lru_cache(64)
def _below(base: str) -> str:
    return urljoin(base, "x")[:-1]


@lru_cache(_KNOWN_TERMS)
def _named(base: str | None, value: str) -> tuple:
    """The term of an IRI, name or blank node of a simple statement."""
    if value[0] == "<":
        return None, _resolved(base, value), None, None
    if value[0] == "_":
        return None, value, None, None
    prefix, _, local = value.partition(":")
    return prefix, local, None, None


def _simple(text: str, base: str | None) -> list[tuple[tuple, tuple, tuple]] | None:
    """The triples of a simple statement; None if it is not one."""
    if not _SIMPLE.fullmatch(text):
        return None
    items = iter(_SIMPLE_ITEM.findall(text))
    subject, predicate, triples = _named(base, next(items)), None, []
    for item in items:
        if item == ";":
            predicate = None
        elif item == "," or item == ".":
            continue
        elif predicate is None:
            predicate = (None, f"<{_RDF}type>", None, None) if item == "a" else _named(base, item)
        elif item[0] != '"' or item[-1] == '"':
            triples.append((subject, predicate, (None, item, None, None) if item[0] == '"' else _named(base, item)))
        else:
            end = item.rindex('"') + 1
            if item[end] == "^":
                prefix, name, _, _ = _named(base, item[end + 2:])
                triples.append((subject, predicate, (None, f"{item[:end]}^^{name}", None, None) if prefix is None else (None, item[:end], prefix, name)))
            else:
                triples.append((subject, predicate, (None, item, None, None)))
    return triples


def expand(text: str, base: str | None, place: str) -> list[tuple[tuple, tuple, tuple]]:
    """The triples of a statement. A term is ``(name prefix or None, text, datatype's prefix or None, datatype)``.

    IRIs, blank nodes and plain literals are N-Triples terms already; of a
    prefixed name the prefix awaits its binding. ``place`` makes the labels of
    unnamed blank nodes.
    """
    simple = _simple(text, base)
    if simple is not None:
        return simple
    tokens = [*_tokens(text)]
    at, triples, fresh = 0, [], 0

    def take(*kinds: str) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or kinds and tokens[at][0] not in kinds and tokens[at][1] not in kinds:
            raise Rejected(tokens[at][1] if at < len(tokens) else "end")
        at += 1
        return tokens[at - 1]

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) else ""

    def node() -> tuple:
        nonlocal fresh
        fresh += 1
        return None, f"_:{place}.{fresh}", None, None

    def reference(kind: str, value: str) -> tuple:
        if kind == "iri":
            return None, _resolved(base, value), None, None
        prefix, _, local = value.partition(":")
        return prefix, re.sub(r"\\(.)", r"\1", local), None, None

    def term(role: str) -> tuple:
        kind, value = take()
        if kind in ("iri", "name"):
            return reference(kind, value)
        if role == "predicate":
            if value == "a":
                return None, f"<{_RDF}type>", None, None
            raise Rejected(value)
        if kind == "bnode":
            return None, value, None, None
        if value == "[":
            own = node()
            if peek() != "]":
                predicates(own)
            take("]")
            return own
        if value == "(":
            items = []
            while peek() != ")":
                items.append(term("object"))
            take(")")
            nodes = [node() for _ in items]
            nil = (None, f"<{_RDF}nil>", None, None)
            for i, (own, item) in enumerate(zip(nodes, items)):
                triples.append((own, (None, f"<{_RDF}first>", None, None), item))
                triples.append((own, (None, f"<{_RDF}rest>", None, None), nodes[i + 1] if i + 1 < len(nodes) else nil))
            return nodes[0] if nodes else nil
        if role == "object":
            if kind == "string":
                quoted = _quoted(value)
                if at < len(tokens) and tokens[at][0] == "at":
                    return None, quoted + take()[1], None, None
                if peek() == "^^":
                    take()
                    prefix, name, _, _ = reference(*take("iri", "name"))
                    return (None, f"{quoted}^^{name}", None, None) if prefix is None else (None, quoted, prefix, name)
                return None, quoted, None, None
            if kind == "number":
                own = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
                return None, f'"{value}"^^<{_XSD}{own}>', None, None
            if value in ("true", "false"):
                return None, f'"{value}"^^<{_XSD}boolean>', None, None
        raise Rejected(value)

    def predicates(subject: tuple) -> None:
        while True:
            predicate = term("predicate")
            while True:
                triples.append((subject, predicate, term("object")))
                if peek() != ",":
                    break
                take()
            if peek() != ";":
                return
            while peek() == ";":
                take()
            if peek() in (".", "]"):
                return

    alone = peek() == "["
    subject = term("subject")
    if not (alone and peek() == "."):  # [ ... ] . needs no predicate behind it
        predicates(subject)
    take(".")
    if at < len(tokens):
        raise Rejected(tokens[at][1])
    return triples


# ------------------------------------------------------------------ Spark side

_SPLIT = "file string, split bigint"
#: Where the first statement of a file begins if its first split has cut it off: before all splits.
BEFORE = -(1 << 62)
_DIRECTIVE = r"(?is)^(?:\s|#[^\n]*\n)*(@prefix\b|@base\b|prefix\b|base\b)(?:\s|#[^\n]*\n)*(?:((?U)[\w.\-\u00b7]*):)?(?:\s|#[^\n]*\n)*<([^<>\s]*)>(?:\s|#[^\n]*\n)*\.?\s*$"


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(file, split, at, value)`` of Turtle files, as Spark splits them; nothing is moved."""
    return (spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: for every state before it, the state behind it and whether a statement ends in it."""
    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()),
                                           pa.array([[now[s] for s in STATES]], pa.list_(pa.int32())),
                                           pa.array([[ended[s] for s in STATES]], pa.list_(pa.bool_()))], ["file", "split", "states", "ended"])

    key = now = ended = None
    done: dict[int, tuple[int, bool]] = {}
    for batch in batches:
        for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (file, split):
                if key:
                    yield row()
                key, now, ended = (file, split), {s: s for s in STATES}, {s: False for s in STATES}
            for state in set(now.values()):  # states that have met stay together
                if state in _LONG and _LONG[state] not in line:
                    continue
                after, ends = advance(state, line)
                if after != state or ends:
                    done[state] = after, bool(ends)
            if done:
                for s in STATES:
                    if now[s] in done:
                        now[s], end = done[now[s]]
                        ended[s] = ended[s] or end
                done.clear()
    if key:
        yield row()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split of a range in order: for every state before the file's first split there, the state before this split
    and the last split with a statement end; a row without split has those behind the range."""
    out: list[tuple] = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                                          ["part", "file", "split", "states", "owners"])

    key = now = owners = None
    for batch in batches:
        for part, file, split, states, ended in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (part, file):
                if key:
                    out.append((*key, None, now, owners))
                key, now, owners = (part, file), [*STATES], [None] * len(STATES)
            out.append((part, file, split, now, owners))
            owners = [split if ended[now[s]] else owners[s] for s in STATES]
            now = [states[now[s]] for s in STATES]
        if len(out) >= 10_000:
            yield batch_of(out)
            out = []
    if key:
        out.append((*key, None, now, owners))
    if out:
        yield batch_of(out)


def _entered(summary: DataFrame) -> DataFrame:
    """``(file, split, before, owner)``: the state that each split starts in, and the split that the statement there begins in.

    Only the ranges of a file, as many as there are tasks at most, come together
    in one row. They are written first, for they must not be cut anew when read
    again, and so are the summaries, which the cut into ranges reads twice.
    """
    spark = summary.sparkSession
    path = new_snapshot_path(spark, "turtle-summaries")
    summary.write.parquet(path)
    ranged = (spark.read.schema(summary.schema).parquet(path).repartitionByRange("file", "split").sortWithinPartitions("file", "split")
              .select(F.spark_partition_id().alias("part"), "file", "split", "states", "ended"))
    schema = f"part int, {_SPLIT}, states array<int>, owners array<bigint>"
    path = new_snapshot_path(spark, "turtle-runs")
    ranged.mapInArrow(_composed, schema).write.parquet(path)
    runs = spark.read.schema(schema).parquet(path)
    order = F.array_sort(F.collect_list(F.struct("part", "states", "owners")))
    first = F.struct(F.lit(BETWEEN).alias("state"), F.lit(BEFORE).alias("owner"), F.array().cast("array<struct<part:int,state:int,owner:bigint>>").alias("seen"))
    walk = F.aggregate("ranges", first, lambda a, x: F.struct(
        x["states"][a["state"]].alias("state"), F.coalesce(x["owners"][a["state"]], a["owner"]).alias("owner"),
        F.concat(a["seen"], F.array(F.struct(x["part"].alias("part"), a["state"].alias("state"), a["owner"].alias("owner")))).alias("seen")))
    starts = broadcast_if_bounded(runs.filter("split is null").groupBy("file").agg(order.alias("ranges")).select("file", F.inline(walk["seen"])))
    return runs.filter("split is not null").join(starts, ["file", "part"]).select(
        "file", "split", F.col("states")[F.col("state")].alias("before"), F.coalesce(F.col("owners")[F.col("state")], "owner").alias("owner"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of each split, numbered; the piece before its first end has number 0, that behind the last ``last``.

    ``begun`` is the split that a piece's statement begins in.
    """
    out: list[tuple] = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))],
                                          ["file", "split", "begun", "no", "last", "text"])

    key, state, no, held = None, BETWEEN, 0, []
    for batch in batches:
        for file, split, before, owner, line in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (file, split):
                if key:
                    out.append((*key, key[1] if no else first, no, True, "\n".join(held)))
                key, state, first, no, held = (file, split), before, owner, 0, []
            state, ends = advance(state, line)
            start = 0
            for end in ends:
                out.append((file, split, split if no else first, no, False, "\n".join([*held, line[start:end]])))
                no, held, start = no + 1, [], end
            held.append(line[start:])
        if len(out) >= 1_000:
            yield batch_of(out)
            out = []
    if key:
        out.append((*key, key[1] if no else first, no, True, "\n".join(held)))
    if out:
        yield batch_of(out)


def statements(lines: DataFrame) -> DataFrame:
    """``(file, split, no, text)``: the statements of lines ``(file, split, at, value)``, numbered in order within their file.

    The rows of a split must follow each other in order, as a reader's do. A
    statement belongs to the split that it begins in. What follows the last end
    of a file, if more than blanks and comments, is a statement too, which no
    parser accepts. A statement is one value, so its text must fit a row.
    """
    ship_package(lines.sparkSession)
    summary = lines.select("file", "split", "value").mapInArrow(_summaries, f"{_SPLIT}, states array<int>, ended array<boolean>")
    path = new_snapshot_path(lines.sparkSession, "turtle-splits")
    _entered(summary).write.parquet(path)
    splits = lines.sparkSession.read.schema(f"{_SPLIT}, before int, owner bigint").parquet(path)

    # where the statement that a split starts in begins comes with its lines, so that no piece is moved to learn it
    entries = broadcast_if_bounded(splits)
    known = lines.join(entries, ["file", "split"], "left")
    if not entries._bounded:  # a shuffle join loses the order
        known = known.repartition("file", "split").sortWithinPartitions("file", "split", "at")
    pieces = known.select("file", "split", F.coalesce("before", F.lit(BETWEEN)).alias("before"), "owner", "value").mapInArrow(
        _cut, f"{_SPLIT}, begun bigint, no bigint, last boolean, text string")
    whole = pieces.filter(~F.col("last") & (F.col("no") > 0)).select("file", "split", "no", "text")
    # the first and last piece of each split, by the split that the statement begins in; BEFORE is before the first
    ends = pieces.filter((F.col("last") | (F.col("no") == 0)) & F.col("begun").isNotNull())
    joined = (ends.groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("split", "no", "text"))).alias("parts"))
              .select("file", F.col("begun").alias("split"), F.lit((1 << 62)).alias("no"),
                      F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text")))
    blank = r"(?s)^(?:\s|#[^\n]*(?:\n|$))*+$"
    return whole.unionByName(joined.filter(~F.col("text").rlike(blank)))


def bindings(found: DataFrame) -> DataFrame:
    """``(file, name, iri, start, stop)``: what directives bind, and the places between which it holds; the name of a base is null.

    IRIs relative to a base are resolved by it; before any base they are no bindings.
    """
    kind = F.lower(F.regexp_extract("text", _DIRECTIVE, 1))
    raw = found.filter(F.col("text").rlike(_DIRECTIVE)).select(
        "file", F.struct("split", "no").alias("start"), F.when(F.endswith(kind, F.lit("prefix")), F.regexp_extract("text", _DIRECTIVE, 2)).alias("name"),
        F.regexp_extract("text", _DIRECTIVE, 3).alias("iri"))
    following = Window.partitionBy("file", "name").orderBy("start")
    return raw.withColumn("stop", F.lead("start").over(following))


def _holds(place, side) -> "F.Column":
    return (place > side["start"]) & (side["stop"].isNull() | (place < side["stop"]))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f"{r}_{f}" for r in "spo" for f in ("prefix", "text", "dt_prefix", "dt")]
    types = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * (1 + len(names))
    for batch in batches:
        rows: list[tuple] = []
        for file, split, no, text, base in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                found = expand(text, base, f"{split:x}.{no:x}")
                head = (file, split, no, None)
            except (Rejected, RecursionError, ValueError):
                found, head = [((None,) * 4,) * 3], (file, split, no, text)
            rows += [head + s + p + o for s, p, o in found]
        columns = zip(*rows) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "split", "no", "bad", *names])


def parse_turtle(lines: DataFrame, batch_id: str, namespaces=None, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(triples, rejects)`` of Turtle lines ``(file, split, at, value)`` (see :func:`read_turtle`).

    Triples are distinct and in stored form; blank nodes are labelled by batch,
    file and, if unnamed, place. With ``parts`` the files are those of one
    export, so a blank node's name means the same in all of them. A statement that is no Turtle, or that uses a
    prefix or a base not bound before it, is rejected as a whole, with its text
    (and the comments right before it) in ``value``; the others of its file are kept. Null lines are empty ones; an
    empty table gives empty results; other columns are not read.
    """
    with freed_shuffles(lines.sparkSession):
        triples, rejects, _ = _parsed(lines, batch_id, namespaces, parts)
    return triples, rejects


def import_turtle(g: DataFrame, lines: DataFrame, batch_id: str, namespaces=None, parts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(merged_graph, added, rejects)`` of a graph and Turtle lines, each as :func:`parse_turtle` and ``merge_parsed`` have it.

    What a step has written goes as soon as the next one is written, so that the
    text is on disk twice at most beside the shuffles of one step.
    """
    spark = lines.sparkSession
    with freed_shuffles(spark):
        triples, rejects, (texts, terms) = _parsed(lines, batch_id, namespaces, parts)
        path = new_snapshot_path(spark, "turtle-rejects")
        rejects.write.parquet(path)
        rejects = spark.read.schema("value string").parquet(path)
        drop_snapshot(spark, texts)
        merged, added = merge_parsed(g, triples)
        drop_snapshot(spark, terms)
    return merged, added, rejects


def _parsed(lines: DataFrame, batch_id: str, namespaces, parts: bool) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """What :func:`parse_turtle` returns, and where the texts of the statements (read by the rejects) and their terms (by both) are."""
    spark = lines.sparkSession
    lines = lines.select("file", "split", "at", F.coalesce("value", F.lit("")).alias("value"))
    texts = path = new_snapshot_path(spark, "turtle-statements")
    statements(lines).write.parquet(path)
    found = spark.read.schema(f"{_SPLIT}, no bigint, text string").parquet(path)
    bound = bindings(found)
    path = new_snapshot_path(spark, "turtle-bindings")
    bound.write.parquet(path)
    bound = spark.read.schema(bound.schema).parquet(path)
    place = F.struct("split", "no")
    # a base, once there is one, holds for all that follows, so its own side is small
    bases = broadcast_if_bounded(bound.filter("name is null").withColumnRenamed("file", "of"))
    told = found.filter(~F.col("text").rlike(_DIRECTIVE)).join(
        bases, (F.col("file") == bases["of"]) & _holds(place, bases), "left").select("file", "split", "no", "text", F.col("iri").alias("base"))
    fields = [f"{r}_{f}" for r in "spo" for f in ("prefix", "text", "dt_prefix", "dt")]
    terms = told.mapInArrow(_expand, f"{_SPLIT}, no bigint, bad string, " + ", ".join(f"{f} string" for f in fields))

    prefixes = bound.filter("name is not null").join(bases.select("of", F.col("iri").alias("base"), F.col("start").alias("bs"), F.col("stop").alias("be")),
        (F.col("file") == F.col("of")) & (F.col("start") > F.col("bs")) & (F.col("be").isNull() | (F.col("start") < F.col("be"))), "left")
    absolute = F.col("iri").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    prefixes = broadcast_if_bounded(prefixes.filter(absolute | F.col("base").isNotNull()).select(
        F.col("file").alias("of"), "name", F.when(absolute, F.col("iri")).otherwise(F.concat(F.regexp_replace("base", "[^/]*$", ""), F.col("iri"))).alias("iri"),
        "start", "stop"))
    out = terms
    for field in ("s_prefix", "p_prefix", "o_prefix", "o_dt_prefix"):
        side = prefixes.select(*[F.col(c).alias(f"{field}_{c}") for c in prefixes.columns])
        if prefixes._bounded:
            side = F.broadcast(side)
        start, stop = F.col(f"{field}_start"), F.col(f"{field}_stop")
        out = out.join(side, (F.col("file") == F.col(f"{field}_of")) & (F.col(field) == F.col(f"{field}_name"))
                       & (place > start) & (stop.isNull() | (place < stop)), "left").drop(f"{field}_of", f"{field}_name", f"{field}_start", f"{field}_stop")

    def full(prefix: str, text: str):
        return F.when(F.col(prefix).isNull(), F.col(text)).otherwise(F.concat(F.lit("<"), F.col(f"{prefix}_iri"), F.col(text), F.lit(">")))

    typed = F.when(F.col("o_dt_prefix").isNotNull(), F.concat(F.col("o_text"), F.lit("^^"), full("o_dt_prefix", "o_dt"))).otherwise(full("o_prefix", "o_text"))
    stored = path = new_snapshot_path(spark, "turtle-terms")
    (out.select("file", "split", "no", "bad", full("s_prefix", "s_text").alias("ts"), full("p_prefix", "p_text").alias("tp"), typed.alias("to"))
     .write.parquet(path))
    done = spark.read.schema(f"{_SPLIT}, no bigint, bad string, ts string, tp string, to string").parquet(path)

    keys = ["file", "split", "no"]
    path = new_snapshot_path(spark, "turtle-unbound")
    (done.filter(F.col("bad").isNull() & (F.col("ts").isNull() | F.col("tp").isNull() | F.col("to").isNull()))
     .select(*keys).distinct().write.parquet(path))
    unbound = broadcast_if_bounded(spark.read.schema(f"{_SPLIT}, no bigint").parquet(path))
    kept = done.filter(F.col("bad").isNull()).join(unbound, keys, "left_anti")
    rejects = done.filter(F.col("bad").isNotNull()).select(F.col("bad").alias("value")).unionByName(
        found.join(unbound, keys, "left_semi").select(F.col("text").alias("value")))

    rejects = rejects.select(F.regexp_replace("value", r"^\s+", "").alias("value"))

    def labelled(column: str):  # labels are those of one file
        label = F.substring(F.col(column), 3, 1 << 30)
        own = F.concat(F.lit("_:"), F.substring(F.sha2(F.col("file").cast("binary"), 256), 1, 12), F.lit("_"), label)
        if parts:  # an unnamed node's label is its place, which only one file has
            own = F.when(label.rlike(r"^-?[0-9a-f]+\.[0-9a-f]+\.[0-9]+$"), own).otherwise(F.col(column))
        return F.when(F.startswith(F.col(column), F.lit("_:")), own).otherwise(F.col(column)).alias(column)

    return decode_terms(kept.select(labelled("ts"), "tp", labelled("to")), batch_id, namespaces), rejects, (texts, stored)
