"""P4 / P5 over a table of namespaces of any size: the longest bound prefix of an IRI, and back.

``namespaces`` is a table ``(prefix, iri)``. Namespaces may nest; an IRI belongs
to the longest that it begins with. Candidates are found by equality, not by
comparing every IRI with every namespace: an IRI gives one row per length that
some namespace has (and that it is long enough for), which meets the namespaces
in a join on that beginning. The few lengths are one aggregate; the namespace
side is broadcast behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.operators.joins import broadcast_if_bounded


def bindings(namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, conflicts)`` of a table ``(prefix, iri)``.

    A prefix bound to several IRIs means none of them; its rows are the
    conflicts. Repeated rows are one. A null prefix or IRI, and an empty IRI,
    bind nothing. Several prefixes of one IRI are all valid.
    """
    own = namespaces.select("prefix", "iri").filter("prefix is not null and iri <> ''").distinct()
    twice = own.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("prefix")
    return own.join(twice, "prefix", "left_anti"), own.join(twice, "prefix", "left_semi")


def compact_iris(iris: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Distinct ``(iri, qname)``; ``qname`` is ``prefix:rest`` by the longest namespace, null under none.

    Of several prefixes of that namespace the smallest is taken. ``namespaces``
    are valid :func:`bindings`. Other columns of ``iris`` are not read.
    """
    by_iri = namespaces.groupBy(F.col("iri").alias("ns")).agg(F.min("prefix").alias("prefix"))
    lengths = F.array_sort(F.collect_set(F.length("ns")))  # no more than the longest namespace has characters
    found = by_iri.agg(lengths.alias("lengths")).first()["lengths"]
    todo = iris.select("iri").distinct()
    if not found:
        return todo.withColumn("qname", F.lit(None).cast("string"))
    fitting = F.filter(F.array(*map(F.lit, found)), lambda n: n <= F.length("iri"))
    beginnings = todo.select("iri", F.explode(F.transform(fitting, lambda n: F.substr("iri", F.lit(1), n))).alias("ns"))
    longest = (beginnings.join(broadcast_if_bounded(by_iri), "ns")
               .groupBy("iri").agg(F.max(F.struct(F.length("ns").alias("length"), "prefix")).alias("best")))
    qname = F.concat("best.prefix", F.lit(":"), F.substr("iri", F.col("best.length") + 1))
    return todo.join(longest.select("iri", qname.alias("qname")), "iri", "left")


def expand_curies(curies: DataFrame, namespaces: DataFrame) -> DataFrame:
    """P5: ``curies`` with ``iri``, null without ``:`` or under an unbound prefix; rows and columns are kept."""
    at = F.instr("curie", ":")
    side = broadcast_if_bounded(namespaces.select(F.col("prefix").alias("_bound"), F.col("iri").alias("_ns")))
    bound = F.when(at > 0, F.substr("curie", F.lit(1), at - 1))
    return (curies.join(side, bound == F.col("_bound"), "left")
            .withColumn("iri", F.concat("_ns", F.substr("curie", at + 1))).drop("_bound", "_ns"))
