"""Scalar column functions (all JVM-side built-ins, no Python UDFs).

P1  mint_iri            user namespace + percent-quoted name (Python ``quote`` rules)
P1b mint_iri_parts      join parts with a separator, ``encodeURIComponent`` rules
P2  qualified_name      ``catalog.schema.table[.column]``
P3  local_name          last ``/`` segment, then last ``#`` segment
P4  compact_iri         full IRI -> ``prefix:local`` for bound namespaces
P5  expand_curie        ``prefix:local`` -> full IRI; NULL when the prefix is unbound
P6  literal_value       typed access to a literal by its datatype
P11 display_label       empty or missing label -> local name
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontocat.model import DEFAULT_NAMESPACES, USER_NS

# Vocabulary namespaces are stored compact; all other IRIs are stored in full.
VOCAB_PREFIXES = ("rdf", "rdfs", "skos", "owl", "uc", "xsd")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_quote(x: Column | str) -> Column:
    """Python ``urllib.parse.quote(x)``: keep letters, digits, ``_.-~`` and ``/``.

    ``url_encode`` is form encoding (space -> ``+``, keeps ``*``, encodes ``~``
    and ``/``); the replacements turn it into path quoting. A literal ``+`` is
    encoded as ``%2B`` first, so every ``+`` left stands for a space.
    """
    e = F.url_encode(_c(x))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%2F"), F.lit("/"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def uri_component(x: Column | str) -> Column:
    """JavaScript ``encodeURIComponent(x)``: also keeps ``!~*'()``, encodes ``/``."""
    e = F.url_encode(_c(x))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    for enc, ch in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e


def mint_iri(name: Column | str, namespace: str = USER_NS) -> Column:
    """IRI for a catalog object name."""
    return F.concat(F.lit(namespace), url_quote(name))


def mint_iri_parts(*parts: Column | str, sep: str = ".", namespace: str = USER_NS) -> Column:
    """Client-side IRI; only when every part is present and non-empty."""
    cols = [_c(p) for p in parts]
    present = None
    for c in cols:
        cond = c.isNotNull() & (c != "")
        present = cond if present is None else present & cond
    return F.when(present, F.concat(F.lit(namespace), uri_component(F.concat_ws(sep, *cols))))


def qualified_name(*parts: Column | str) -> Column:
    """Dotted catalog name."""
    return F.concat_ws(".", *[_c(p) for p in parts])


def local_name(uri: Column | str) -> Column:
    """``uri.split('/').pop().split('#').pop()`` of the full IRI."""
    last = F.element_at(F.split(export_form(uri), "/"), -1)
    return F.element_at(F.split(last, "#"), -1)


def display_label(label: Column | str, uri: Column | str) -> Column:
    """Label, or the local name when the label is missing or empty."""
    lab = _c(label)
    return F.when(lab.isNull() | (lab == ""), local_name(uri)).otherwise(lab)


def _ordered(namespaces: dict[str, str] | None) -> list[tuple[str, str]]:
    ns = namespaces or DEFAULT_NAMESPACES
    # Longest IRI first so a nested namespace wins over its parent.
    return sorted(ns.items(), key=lambda kv: (-len(kv[1]), kv[0]))


def compact_iri(x: Column | str, namespaces: dict[str, str] | None = None,
                prefixes: tuple[str, ...] | None = None) -> Column:
    """``prefix:local`` for an IRI under a bound namespace, else NULL.

    ``prefixes`` limits which bindings are used (e.g. vocabulary only).
    """
    xc = _c(x)
    out = None
    for prefix, ns_iri in _ordered(namespaces):
        if prefixes is not None and prefix not in prefixes:
            continue
        hit = F.startswith(xc, F.lit(ns_iri))
        val = F.concat(F.lit(prefix + ":"), F.substring(xc, len(ns_iri) + 1, 1 << 30))
        out = F.when(hit, val) if out is None else out.when(hit, val)
    return out if out is not None else F.lit(None).cast("string")


def expand_curie(x: Column | str, namespaces: dict[str, str] | None = None) -> Column:
    """P5: full IRI for ``prefix:local``; NULL when there is no ``:`` or the prefix is unbound."""
    xc = _c(x)
    at = F.instr(xc, ":")
    bound = F.create_map(*[F.lit(t) for pair in sorted((namespaces or DEFAULT_NAMESPACES).items()) for t in pair])
    return F.when(at > 0, F.concat(bound[F.substr(xc, F.lit(1), at - 1)], F.substr(xc, at + 1)))


def store_form(full_iri: Column | str, namespaces: dict[str, str] | None = None) -> Column:
    """Stored form of an IRI: compact for vocabulary namespaces, else unchanged."""
    return F.coalesce(compact_iri(full_iri, namespaces, VOCAB_PREFIXES), _c(full_iri))


def export_form(term: Column | str, namespaces: dict[str, str] | None = None) -> Column:
    """Inverse of :func:`store_form` for IRIs (vocabulary CURIEs are expanded)."""
    vocabulary = {p: iri for p, iri in (namespaces or DEFAULT_NAMESPACES).items() if p in VOCAB_PREFIXES}
    return F.coalesce(expand_curie(term, vocabulary), _c(term))


# XSD datatypes decoded by literal_value, grouped by target type.
INTEGER_TYPES = ("xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:byte",
                 "xsd:nonNegativeInteger", "xsd:positiveInteger", "xsd:negativeInteger",
                 "xsd:nonPositiveInteger", "xsd:unsignedInt", "xsd:unsignedLong",
                 "xsd:unsignedShort", "xsd:unsignedByte")
DECIMAL_TYPES = ("xsd:decimal", "xsd:double", "xsd:float")


def literal_value(o: Column | str, datatype: Column | str) -> dict[str, Column]:
    """Typed views of a literal; each is NULL unless the datatype selects it."""
    oc, dt = _c(o), _c(datatype)
    return {
        "value_long": F.when(dt.isin(*INTEGER_TYPES), oc.try_cast("bigint")),
        "value_double": F.when(dt.isin(*DECIMAL_TYPES), oc.try_cast("double")),
        "value_boolean": F.when(dt == "xsd:boolean", F.when(oc.isin("true", "1"), True)
                                .when(oc.isin("false", "0"), False)),
        "value_date": F.when(dt == "xsd:date", oc.try_cast("date")),
        "value_timestamp": F.when(dt == "xsd:dateTime", oc.try_cast("timestamp_ntz")),
        "value_string": F.when(dt.isNull() | (dt == "xsd:string"), oc),
    }


def jinja_text(x: Column | str) -> Column:
    """How a template renders a value: a missing value prints as ``None``."""
    return F.coalesce(_c(x), F.lit("None"))
