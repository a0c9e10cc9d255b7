"""Line dedup by pairwise patience alignment of documents that share lines."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ontocat.llm.common import cut, free_name

#: Lines of fewer characters, blanks not counted, are no anchors; they go inside an aligned block or with a whole copy.
ANCHOR_CHARS = 5


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of ``(later position, earlier position)`` pairs that rises in both; pairs come sorted."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for at, (_, p) in enumerate(pairs):
        pile = bisect_left(tops, p)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(p)
            ends.append(at)
        else:
            tops[pile], ends[pile] = p, at
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(pairs[at])
        at = back[at]
    return chain[::-1]


def singles(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a document that can be anchors and are there once, in order of their hash, and their positions."""
    found, at, n = np.unique(lines, return_index=True, return_counts=True)
    once = (n == 1) & (found & 1 == 1)
    return found[once], at[once]


def aligned(later: np.ndarray, earlier: np.ndarray) -> set[int]:
    """Positions of the later document inside blocks that it has in common with the earlier one.

    Documents are arrays of line hashes, 0 for blank lines; odd hashes can be
    anchors. Anchors are lines unique in both. Each anchor of the patience chain
    grows over equal neighbours on both sides as far as the next anchor.
    """
    (mine, at), (other, there) = singles(later), singles(earlier)
    _, i, j = np.intersect1d(mine, other, assume_unique=True, return_indices=True)
    chain = patience(sorted(zip(at[i].tolist(), there[j].tolist())))
    a, b = later.tolist(), earlier.tolist()
    found: set[int] = set()
    edges = [(-1, -1), *chain, (len(a), len(b))]
    for n in range(1, len(edges) - 1):
        found.add(edges[n][0])
        for step, (stop_l, stop_e) in ((-1, edges[n - 1]), (1, edges[n + 1])):
            i, j = edges[n][0] + step, edges[n][1] + step
            while i != stop_l and j != stop_e and a[i] and a[i] == b[j]:
                found.add(i)
                i, j = i + step, j + step
    return found


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return (flat[a:z] for a, z in zip(offsets[:-1], offsets[1:]))


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and line that can be an anchor in it."""
    for batch in batches:
        found = [singles(lines)[0] for lines in _arrays(batch.column(2))]
        if found:
            n = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), n), pa.int64()) for c in (0, 1)]
                                             + [pa.array(np.concatenate(found), pa.int64())], ["doc", "row", "line"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document pair to the later document's positions in common blocks, and the lines there."""
    for batch in batches:
        gone, lines = [], []
        for later, earlier in zip(_arrays(batch.column(2)), _arrays(batch.column(3))):
            gone.append(np.array(sorted(aligned(later, earlier)), np.int32))
            lines.append(later[gone[-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())),
                                          pa.array(lines, pa.list_(pa.int64()))], ["doc", "row", "gone", "lines"])


@arrow_udf(StringType())
def _without(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, gone in texts:
        out = []
        for t, g in zip(text.to_pylist(), gone.to_pylist()):
            if t is not None and g:
                drop = set(g)
                t = "\n".join(x for at, x in enumerate(t.split("\n")) if at not in drop)
            out.append(t)
        yield pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", anchor_chars: int = ANCHOR_CHARS,
                out: str = "deduped") -> DataFrame:
    """``docs`` with a struct column ``out``: n_lines, n_deleted, text without the lines an earlier document has.

    Documents with the same lines, blank ones aside, are one class: its first
    document (by id) stays for the others, which lose all their lines. The first
    ones are paired by lines that can be anchors: lines of ``anchor_chars``
    characters or more that are in a document once. Each such line pairs every
    later document with the first document that has it once, never all with
    all, and no frequency has to be cut off. A pair is aligned by patience diff
    over all lines of both documents: the longest common chain of the lines
    unique in both is kept, and blocks grow from it over equal neighbours. The
    blocks are deleted from the later document.

    A line that its document has kept, as it is outside the chain, is paired in
    the next round with the first of the later documents that have kept it too.
    Rounds end when no line has another document to be paired with. So a line
    that can be an anchor stays only if aligning its document with each earlier
    one that keeps it does not reach it.

    Lines are the parts between ``\\n``, compared without blanks at their ends.
    Null texts have 0 lines and stay null, empty texts have one blank line. Rows
    equal in id and text are one document; documents of equal id are ordered by
    a hash of their text, null ids come last. Other columns are kept; one called
    ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    doc, row, gone_name = (free_name(docs, n) for n in ("_doc", "_row", "_gone"))
    last = F.lit((1 << 63) - 1)
    numbered = docs.select(*kept, F.coalesce(docs[doc_id].cast("bigint"), last).alias(doc), F.xxhash64(docs[text]).alias(row))
    trimmed = F.transform(F.split(numbered[text], "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")))
    # the last bit of a hash tells whether the line can be an anchor
    hashed = F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(
        F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(F.translate(x, " ", "")) >= anchor_chars).cast("bigint"))))
    firsts = (numbered.filter(numbered[text].isNotNull())
              .select(F.col(doc).alias("doc"), F.col(row).alias("row"), trimmed.alias("lines"))
              .select(F.md5(F.concat_ws("\n", F.filter("lines", lambda x: x != ""))).alias("whole"), "doc", "row", hashed.alias("lines"))
              .groupBy("whole").agg(F.min(F.struct("doc", "row", "lines")).alias("first")).select("first.*"))
    firsts = cut(firsts)
    left = firsts.mapInArrow(_singles, "doc bigint, row bigint, line bigint")
    later, earlier = (firsts.select(F.col("doc").alias(d), F.col("row").alias(f"{d}_row"), F.col("lines").alias(f"{d}_lines"))
                      for d in ("later", "earlier"))
    found = []
    while True:
        owners = (left.groupBy("line").agg(F.min(F.struct("doc", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1").drop("n"))
        owners = cut(owners)  # so that the join below is one whose hot lines Spark can split
        left = cut(left.join(owners, "line").filter("doc != first.doc or row != first.row"))
        if left.isEmpty():
            break
        pairs = left.select(F.col("doc").alias("later"), F.col("row").alias("later_row"), F.col("first.doc").alias("earlier"),
                            F.col("first.row").alias("earlier_row")).distinct()
        pairs = cut(pairs).join(earlier, ["earlier", "earlier_row"]).join(later, ["later", "later_row"])
        found.append(cut(pairs.select("later", "later_row", "later_lines", "earlier_lines")
                         .mapInArrow(_align, "doc bigint, row bigint, gone array<int>, lines array<bigint>")))
        gone = found[-1].select("doc", "row", F.explode("lines").alias("line"))
        left = left.select("doc", "row", "line").join(gone, ["doc", "row", "line"], "left_anti")
    gone = functools.reduce(DataFrame.unionByName, found) if found else firsts.select(
        "doc", "row", F.array().cast("array<int>").alias("gone")).limit(0)
    gone = (gone.groupBy("doc", "row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
    gone = (firsts.select("doc", "row").join(gone, ["doc", "row"], "left")
            .select(F.col("doc").alias(doc), F.col("row").alias(row), F.coalesce("gone", F.array().cast("array<int>")).alias(gone_name)))
    joined = numbered.join(gone, [doc, row], "left")
    all_lines = F.filter(F.transform(trimmed, lambda x, at: F.when(x != "", at)), lambda at: at.isNotNull())
    joined = joined.withColumn(gone_name, F.coalesce(gone_name, all_lines))  # the first of the class has been found above
    return joined.select(*kept, F.struct(
        F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).cast("bigint").alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(gone_name)).cast("bigint").alias("n_deleted"),
        _without(F.col(text), F.col(gone_name)).alias("text")).alias(out))
