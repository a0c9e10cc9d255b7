"""Trigram similarity search over graph literals (F1, F2) and the list filter.

F1, one plan for any batch of queries:

1. the literal partitions are scanned; a literal whose number of trigrams can't
   reach the threshold with any query of the batch is dropped before its
   trigrams become rows (similarity >= num/den bounds the sizes both ways);
2. literal trigrams meet query trigrams in an equi-join on the gram. The query
   side is broadcast when its rows and bytes are under a checked bound, so
   literals are never shuffled and a very common gram cannot skew anything;
   beyond it AQE splits hot grams of a shuffle join;
3. shared grams are counted per (query, triple), partially before the only
   shuffle, which carries matched pairs alone; then the threshold decides;
4. DISTINCT (query, subject, text) over the hits.

Counting per triple (not per subject and text) keeps the count exact when one
subject carries the same text under two predicates. Exact overall: any pair
with similarity > 0 shares at least one gram, and nothing is ranked or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontocat.functions.scalars import jinja_text
from ontocat.functions.trigrams import THRESHOLD_DEN, THRESHOLD_NUM, similar_enough, trigrams
from ontocat.model import literals
from ontocat.operators import entities as ent
from ontocat.operators.joins import broadcast_if_bounded
from ontocat.session import new_snapshot_path


def trigram_search(
    g: DataFrame,
    queries: DataFrame,
    num: int = THRESHOLD_NUM,
    den: int = THRESHOLD_DEN,
) -> DataFrame:
    """DISTINCT ``(query, uri, text)`` with trigram similarity >= num/den.

    ``queries`` has a ``query`` column (other columns are carried through).
    """
    qcols = [c for c in queries.columns if c != "query"]
    q = queries.select("query").distinct()
    out = ent.full_iris(_gram_join(g, q, num, den), "uri")
    if qcols:
        out = out.join(queries.select("query", *qcols).distinct(), "query")
    return out


def _gram_join(g: DataFrame, q: DataFrame, num: int, den: int) -> DataFrame:
    key = ["s", "p", "o", "o_datatype", "o_lang"]
    query_grams = (
        q.select("query", trigrams("query").alias("grams"))
        .select("query", F.size("grams").alias("n_query"), F.explode("grams").alias("gram"))
    )
    sizes = query_grams.agg(F.min("n_query").alias("least"), F.max("n_query").alias("most")).first()
    least, most = (sizes["least"] or 0) * num, (sizes["most"] or 0) * den
    # The generator is a border that the optimiser moves no filter across, so a text is cut into trigrams once.
    text_grams = (
        literals(g).select(*key, F.explode(F.array(trigrams("o"))).alias("grams"))
        .select(*key, F.size("grams").alias("n_text"), "grams")
        .filter((F.col("n_text") * den >= least) & (F.col("n_text") * num <= most))
        .select(*key, "n_text", F.explode("grams").alias("gram"))
    )
    query_grams = broadcast_if_bounded(query_grams)
    shared = (
        text_grams.join(query_grams, "gram")
        .filter((F.col("n_text") * den >= F.col("n_query") * num) & (F.col("n_query") * den >= F.col("n_text") * num))
        .groupBy("query", "n_query", *key, "n_text")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        shared.filter(similar_enough(F.col("shared"), F.col("n_text"), F.col("n_query"), num, den))
        .select("query", F.col("s").alias("uri"), F.col("o").alias("text"))
        .distinct()
    )


def trigram_search_kind(g: DataFrame, queries: DataFrame) -> DataFrame:
    """F1 narrowed by ``kind``: ``concept`` / ``property`` keep subjects of that
    kind; ``all`` or NULL keeps every hit. Output ``(query, kind, uri, text)``."""
    hits = trigram_search(g, queries.select("query", "kind"))
    is_c = ent.full_iris(ent.concept_members(g), "uri").withColumn("is_concept", F.lit(True))
    is_p = ent.full_iris(ent.property_members(g), "uri").withColumn("is_property", F.lit(True))
    flagged = hits.join(is_c, "uri", "left").join(is_p, "uri", "left")
    k = F.col("kind")
    keep = (
        k.isNull()
        | (k == "all")
        | ((k == "concept") & F.col("is_concept").isNotNull())
        | ((k == "property") & F.col("is_property").isNotNull())
    )
    return flagged.filter(keep).select("query", "kind", "uri", "text")


def list_filter(g: DataFrame, filters: DataFrame) -> DataFrame:
    """Items of the four entity lists whose searchable text contains a filter string.

    Searchable text, joined by spaces as the page does: concepts and properties
    = alt labels (space-joined), URI, label; tables and columns = URI, name. A
    missing label or name is rendered as ``None`` and is searchable as such.
    ``filters`` has a ``q`` column. Output ``(q, list, uri, label)``.

    The text is never joined whole. Each field is a row ``(item, place, text)``
    that carries the end of the text before it, as long as the longest filter,
    so a match inside a field or across any number of short fields is found in
    the row where it ends, however many alt labels an item has (see
    :func:`_with_text_before`). Of a label's copies, one more than the longest
    filter has characters are all that a match can reach across.
    """
    filters = filters.select("q").distinct()
    longest = filters.agg(F.max(F.length("q"))).first()[0] or 0
    copies = F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n"), F.lit(longest + 1)))
    c = ent.concepts_alt_labels(g, dedupe=False).select(
        F.lit("concepts").alias("list"), "uri", "label", "alt_label", F.explode(copies).alias("copy"))
    p = ent.properties_alt_labels(g).select(
        F.lit("properties").alias("list"), "uri", F.col("name").alias("label"), "alt_label", F.lit(1).cast("bigint").alias("copy"))
    item = ["list", "uri", "label"]
    many = c.unionByName(p)
    alts = many.select(*item, F.lit(0).alias("place"), F.coalesce("alt_label", F.lit("")).alias("text"), "copy")
    heads = many.select(*item).distinct()
    ends = heads.select(*item, F.lit(1).alias("place"), F.concat_ws(" ", "uri", jinja_text("label")).alias("text"), F.lit(1).cast("bigint").alias("copy"))
    fields = _with_text_before(alts.unionByName(ends), item, longest)
    t = ent.tables(g).select(F.lit("tables").alias("list"), "uri", F.col("name").alias("label"))
    k = ent.columns(g).select(F.lit("columns").alias("list"), "uri", F.col("name").alias("label"))
    plain = t.unionByName(k).select(*item, F.concat_ws(" ", "uri", jinja_text("label")).alias("text"))
    return substring_join(fields.unionByName(plain), filters).select("q", *item).distinct()


def _with_text_before(fields: DataFrame, item: list[str], length: int) -> DataFrame:
    """``text`` preceded by the last ``length`` characters of the item's fields before it, space-joined.

    The fields, in order of (item, place, text, copy), are cut into ranges, so
    an item with very many of them lies in several. Within a range a field
    takes the text before it from a frame of ``length`` rows, which is enough
    since every field is at least one character with its space. Each range
    hands the end of its last item's text on: one row of ``length`` characters
    per range, from which the next ranges of that item compose theirs. The
    ranges are written first, for they must not be cut anew when read again.
    """
    if length < 1:
        return fields.select(*item, "text")
    spark = fields.sparkSession
    order = ["place", "text", "copy"]
    ranged = fields.select(*item, *order).repartitionByRange(*item, *order).withColumn("part", F.spark_partition_id())
    path = new_snapshot_path(spark, "list-fields")
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)

    def end(parts: Column) -> Column:
        return F.right(F.array_join(parts, ""), F.lit(length))

    frame = Window.partitionBy("part", *item).orderBy(*order).rowsBetween(-length, -1)
    near = stored.withColumn("before", end(F.collect_list(F.concat(F.right(F.col("text"), F.lit(length)), F.lit(" "))).over(frame)))
    edges = near.groupBy("part").agg(F.min(F.struct(*item)).alias("opens"), F.max(F.struct(*item, *order, "before")).alias("last")).select(
        "part", "opens", F.struct(*[F.col(f"last.{c}").alias(c) for c in item]).alias("closes"),
        F.right(F.concat("last.before", "last.text", F.lit(" ")), F.lit(length)).alias("tail"))
    earlier = F.collect_list(F.struct("closes", "tail")).over(Window.orderBy("part").rowsBetween(-length, -1))  # a row per range
    handed = edges.withColumn("earlier", earlier).select("part", "opens", end(F.transform(
        F.filter("earlier", lambda x: x["closes"].eqNullSafe(F.col("opens"))), lambda x: x["tail"])).alias("handed")).filter("handed <> ''")
    path = new_snapshot_path(spark, "list-handed")
    handed.write.parquet(path)
    handed = broadcast_if_bounded(spark.read.schema(handed.schema).parquet(path))
    own = F.when(F.struct(*item).eqNullSafe(F.col("opens")), F.col("handed")).otherwise(F.lit(""))
    return near.join(handed, "part", "left").select(
        *item, F.concat(F.right(F.concat(own, F.col("before")), F.lit(length)), F.col("text")).alias("text"))


# Filters are found by their first characters, up to this many.
PREFIX = 3
# Up to this many first pieces of filters are looked for in a text; of more, the pieces of the text meet them by a join alone.
KNOWN_PIECES = 64


def substring_join(items: DataFrame, filters: DataFrame) -> DataFrame:
    """Pairs (item, q) where ``upper(item.text)`` contains ``upper(q)``; NULL filters match nothing.

    A text that contains ``q`` contains its first ``min(3, len(q))`` characters,
    so an equi-join on such pieces (the distinct ones of the text, the first of
    ``q``) finds the candidates, which ``contains`` then decides. The empty
    filter's piece is the empty string, which every text has. The filter side is
    broadcast behind a check of its size, and if its pieces are few, only those
    that a text has become rows.
    """
    ut = F.upper(F.col("text"))
    fq = filters.filter("q is not null").select("q", F.upper("q").alias("uq")).withColumn(
        "piece", F.substr("uq", F.lit(1), F.least(F.length("uq"), F.lit(PREFIX))))
    lengths = sorted(r[0] for r in fq.select(F.length("piece")).distinct().collect())  # at most 4 values
    known = [r[0] for r in fq.select("piece").distinct().limit(KNOWN_PIECES + 1).collect()]

    def pieces(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        starts = F.when(F.length(ut) >= n, F.sequence(F.lit(1), F.length(ut) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substr(ut, i, F.lit(n))))

    if not lengths:
        return items.withColumn("q", F.lit(None).cast("string")).filter(F.lit(False))
    if len(known) <= KNOWN_PIECES:
        found = F.array_compact(F.array(*[F.when(F.contains(ut, F.lit(k)), F.lit(k)) for k in known]))
    else:
        found = F.concat(*[pieces(n) for n in lengths])
    keyed = items.withColumn("piece", F.explode(found))
    return (keyed.join(broadcast_if_bounded(fq), "piece").filter(F.contains(ut, F.col("uq")))
            .select(*items.columns, "q"))
