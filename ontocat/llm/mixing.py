"""Mixing sources to target weights: subset-sum budget fitting over document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from ontocat.llm.common import cut, free_name

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: A budget up to this many words is fitted exactly by dynamic programming.
FIT_WORDS = 1 << 16
#: Parts of a (source, length) group that are ranked independently.
CELLS = 256


@arrow_udf(LongType())
def word_count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of runs without ASCII white space (20, 09-0D), which ``bytes.split`` finds; 0 for null."""
    for chunk in texts:
        yield pa.array([len(t.as_py().split()) if t.is_valid else 0 for t in chunk.cast(pa.binary())], pa.int64())


def fit_budget(counts: dict[int, int], budget: float, limit: int = FIT_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near ``budget`` as the fit finds.

    ``counts``: documents per exact length. First every length gives its share
    of the budget, rounded down. Long documents then fill up until ``limit``
    words are left, and a bounded-knapsack dynamic program over the documents
    not taken yet fits the rest: a bit set of reachable sums, each length split
    into powers of two, read backwards for the choice. Ends at once when the
    budget is met exactly; otherwise the nearest reachable sum counts.
    """
    total = sum(size * n for size, n in counts.items())
    if budget <= 0 or not total:
        return {}
    share = min(1.0, budget / total)
    take = {size: int(n * share) for size, n in counts.items()}
    left = budget - sum(size * n for size, n in take.items())
    for size in sorted(counts, reverse=True):
        if left <= limit:
            break
        more = min(counts[size] - take[size], int((left - limit) // size + 1), int(left // size))
        take[size] += more
        left -= more * size
    want, cap = round(left), int(2 * left)  # further above than taking nothing is below is never nearer
    reach, steps, mask = 1, [], (1 << cap + 1) - 1
    for size in sorted(counts):
        free, part = counts[size] - take[size], 1
        while free > 0 and part * size <= cap and not reach >> want & 1:
            part = min(part, free)
            steps.append((size, part, reach))
            reach |= reach << part * size & mask
            free -= part
            part *= 2
        if size > cap or reach >> want & 1:
            break
    below = (reach & (1 << want + 1) - 1).bit_length() - 1
    rest = reach >> want + 1
    above = want + 1 + (rest & -rest).bit_length() - 1 if rest else None
    best = above if above is not None and above - left < left - below else below
    for size, part, before in reversed(steps):
        if not before >> best & 1:
            best -= part * size
            take[size] += part
    return {size: n for size, n in take.items() if n}


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The plan of one source: its lengths with the number of documents to take once more."""
    take = fit_budget(dict(zip(rows["size"].tolist(), rows["n"].tolist())), float(rows["budget"].iloc[0]))
    return pd.DataFrame({"src": rows["src"].iloc[0], "size": list(take), "n_take": list(take.values())})


def targets(totals: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source ``(src, source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all words; a source gets ``most`` times its size at most, and
    what it can't take is shared by the others by weight. The fixed point is
    min(cap, level * weight); sorted by cap / weight, the level is found at the
    first source that stays below its cap.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights)))
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    words = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * share
    level = (words - full) / rest
    rows = rows.withColumn("level", F.when(F.col("cap") / F.col("weight") >= level, level))
    lowest = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (rows.withColumn("at", lowest)
            .withColumn("target", F.coalesce(F.least("cap", F.col("at") * F.col("weight")), F.col("cap")))
            .drop("weight", "cap", "level", "at"))


def mix_documents(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                  weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0,
                  out: str = "mixed") -> DataFrame:
    """``docs`` with a struct column ``out``: size, source_size, target, taken (words, repeats counted).

    A source whose target is beyond its size gives every document once (or as
    often as fits) and a subset of its documents once more; the subset's length
    counts come from ``fit_budget`` and its documents are those of least seeded
    id hash. The only pass over all texts before the final one adds up
    documents per (source, length, part); everything planned comes from these
    sums, which are checkpointed. One task fits one source, and reads a row per
    distinct length of it, at most about sqrt(2 * words of the source).
    Documents of equal source and length are ranked in ``CELLS`` parts by id
    hash, so a hot group of copies is spread.

    Null and empty texts have size 0 and are never taken. A null source is a
    source, the last one. Rows with equal ids, lengths and sources are
    interchangeable. Without words every target is 0. Other columns are kept;
    one called ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    key, planned, rank = (free_name(docs, n) for n in ("_key", "_plan", "_rank"))
    src = F.coalesce(F.concat(F.lit("="), docs[source]), F.lit("null"))  # never null, so joins match
    rows = docs.select(*kept, F.struct(src.alias("src"), docs[source].alias("source"), word_count(docs[text]).alias("size"),
                                       F.xxhash64(docs[doc_id], F.lit(seed)).alias("h")).alias(out))

    def item(name: str) -> Column:
        return F.col(f"{out}.{name}")

    def part(h: Column) -> Column:
        return F.pmod(F.shiftright(h, 8), F.lit(CELLS)).cast("int")

    cells = cut(rows.groupBy(item("src").alias("src"), item("size").alias("size"), part(item("h")).alias("part"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(item("source")).alias("source")))
    totals = cells.groupBy("src").agg(F.min("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(totals, weights=weights, share=share, most=most).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = cut(plan.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")))
    lengths = cells.filter("size > 0").groupBy("src", "size").agg(F.sum("n").alias("n"))
    extra = (lengths.join(plan.select("src", "budget"), "src").groupBy("src")
             .applyInPandas(_fit, "src string, size bigint, n_take bigint"))
    before = F.sum("n").over(Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    quota = (cells.drop("source").join(extra, ["src", "size"], "left")
             .withColumn("rest", F.coalesce("n_take", F.lit(0)) - F.coalesce(before, F.lit(0)))
             .withColumn("quota", F.greatest(F.lit(0), F.least("n", "rest")))
             .join(plan.select("src", "source_size", "target", "copies"), "src")
             .select(F.struct("src", "size", "part").alias(key),
                     F.struct("quota", "source_size", "target", "copies").alias(planned)))
    keyed = rows.select(*[rows[c] for c in kept], rows[out], F.struct(
        item("src").alias("src"), item("size").alias("size"), part(item("h")).alias("part")).alias(key))
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(item("h"), keyed[doc_id]))
    done = keyed.join(quota, key).withColumn(rank, ranked)
    copies = F.col(f"{planned}.copies") + F.when(F.col(rank) <= F.col(f"{planned}.quota"), 1).otherwise(0)
    return done.select(*[done[c] for c in kept], F.struct(
        item("size").alias("size"), F.col(f"{planned}.source_size").alias("source_size"), F.col(f"{planned}.target").alias("target"),
        (item("size") * copies).alias("taken")).alias(out))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each document as often as it is taken, with its columns."""
    out = free_name(docs, "mixed")
    done = mix_documents(docs, out=out, **options)
    copies = F.when(F.col(f"{out}.size") > 0, F.col(f"{out}.taken") / F.col(f"{out}.size")).otherwise(0).cast("int")
    return (done.filter(F.col(f"{out}.taken") > 0).withColumn(out, F.explode(F.array_repeat(F.lit(1), copies)))
            .select(*[c for c in done.columns if c != out]))
