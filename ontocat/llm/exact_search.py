"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontocat.llm.common import cut, sorted_runs

K = 5
SCALE = 256
#: Integers beyond this size are held at it: up to here they are exact as doubles, and products of 2^18 of them as decimals.
LIMIT = 1 << 53
#: Cells that a component is quantised to (a byte), and rows that the cells' borders are fitted on (every row is then quantised).
CELLS = 256
FIT_ROWS = 4_096
#: Rows and queries that meet in one task: a 24th of all rows, within these bounds, and so many queries at most.
LEAST_PART, MOST_PART, PARTS = 1_024, 131_072, 24
MOST_QUERIES = 32_768
#: Queries compared at a time inside a task.
QUERY_BLOCK = 256

_ENTRY = "part int, qpart int, kind int, id bigint, h bigint, cells binary, vec array<double>"


def whole_numbers(vec: Column) -> Column:
    """``floor(256 * x)`` of each component, as doubles that hold whole numbers within +-2^53."""
    scaled = F.transform(vec, lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT))))
    return F.transform(scaled, lambda x: F.floor(x).cast("double"))


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def borders(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Per component, the ``cells - 1`` borders between equally filled cells."""
    return np.quantile(sample, np.arange(1, cells) / cells, axis=0).T.copy()


def quantise(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component: how many borders it reaches."""
    out = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        out[:, d] = np.searchsorted(edges[d], x[:, d], side="right")
    return out


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    flat, offsets = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _approximate(edges: dict[int, np.ndarray]):
    """The approximation file's rows: id, hash of the vector, and a byte per component."""
    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for rows, x in _by_length(batch.column(2)):
                cells = quantise(x, edges[x.shape[1]]) if x.shape[1] in edges else np.zeros(x.shape, np.uint8)
                for r, c in zip(rows, cells):
                    out[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "h", "cells"])
    return approximate


def _extents(edges: dict[int, np.ndarray]):
    """The least and largest value in each cell of each component, over one batch."""
    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                dims = x.shape[1]
                if not dims:
                    continue
                cells = quantise(x, edges[dims]) if dims in edges else np.zeros(x.shape, np.uint8)
                low, high = np.full((dims, CELLS), np.inf), np.full((dims, CELLS), -np.inf)
                for d in range(dims):
                    np.minimum.at(low[d], cells[:, d], x[:, d])
                    np.maximum.at(high[d], cells[:, d], x[:, d])
                d, c = np.nonzero(low <= high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(d), dims), pa.int32()), pa.array(d, pa.int32()), pa.array(c, pa.int32()),
                     pa.array(low[d, c]), pa.array(high[d, c])], ["dims", "dim", "cell", "low", "high"])
    return extents


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of ``queries`` with any vectors in these ``cells``."""
    at = np.arange(cells.shape[1])
    lo, hi = low[at, cells], high[at, cells]
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    slack = 1e-12 * (np.abs(queries) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def best_bounds(ids: np.ndarray, lower: np.ndarray, k: int) -> float:
    """The k-th largest lower bound, counting each id once with its largest; minus infinity with fewer ids."""
    finite = np.isfinite(lower)
    if finite.sum() < k:
        return -np.inf
    near = np.flatnonzero(finite)
    take = 4 * k
    if len(near) > take:
        near = near[np.argpartition(-lower[near], take)[:take]]
        if len(np.unique(ids[near])) < k:
            near = np.flatnonzero(finite)
    order = near[np.argsort(-lower[near], kind="stable")]
    _, first = np.unique(ids[order], return_index=True)
    return float(lower[order[np.sort(first)[k - 1]]]) if len(first) >= k else -np.inf


def _scan(extents: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Rows that can be among a query's k best as far as one part of the approximation file tells."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["part", "qpart"]):
            keys = np.stack([run["part"].to_numpy(), run["qpart"].to_numpy()])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
            for a, z in zip(starts[:-1], starts[1:]):
                group = run.slice(a, z - a)
                asked = group.filter(pc.equal(group["kind"], 0))
                rows = group.filter(pc.equal(group["kind"], 1))
                if not asked.num_rows or not rows.num_rows:
                    continue
                blobs = rows["cells"].to_pylist()
                sizes = np.array([len(b) for b in blobs])
                ids, hashes = rows["id"].to_numpy(), rows["h"].to_numpy()
                query_ids, query_hashes = asked["id"].to_numpy(), asked["h"].to_numpy()
                for at, vectors in _by_length(asked["vec"].combine_chunks()):
                    dims = vectors.shape[1]
                    own = np.flatnonzero(sizes == dims)
                    if not len(own):
                        continue
                    cells = np.frombuffer(b"".join(blobs[r] for r in own), np.uint8).reshape(len(own), dims)
                    low, high = extents.get(dims, (np.zeros((0, CELLS)),) * 2)
                    for b in range(0, len(at), QUERY_BLOCK):
                        lower, upper = bounds(vectors[b:b + QUERY_BLOCK], cells, low, high)
                        out = []
                        for q, lo, up in zip(at[b:b + QUERY_BLOCK], lower, upper):
                            mine = ids[own] == query_ids[q]
                            lo[mine] = -np.inf
                            keep = np.flatnonzero((up >= best_bounds(ids[own], lo, k)) & ~mine)
                            out.append((np.full(len(keep), query_ids[q]), np.full(len(keep), query_hashes[q]), ids[own][keep],
                                        hashes[own][keep], lo[keep], up[keep]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                         ["query_id", "query_h", "vec_id", "h", "lower", "upper"])
    return scan


def _first(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query; each task keeps its own first k before they meet."""
    return (frame.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
            .filter(F.col("at") <= k).drop("at"))


def _exact(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query_id, vec_id, score)`` of pairs of query and row, from the whole vectors: the best over rows of one id."""
    one = queries.select(F.col("id").alias("query_id"), F.col("h").alias("query_h"), F.col("vec").alias("query_vec"))
    two = rows.select(F.col("id").alias("vec_id"), "h", "vec")
    product = F.aggregate(F.zip_with("query_vec", "vec", lambda x, y: x.cast("decimal(17,0)") * y.cast("decimal(17,0)")),
                          F.lit(0).cast("decimal(38,0)"), lambda s, p: (s + p).cast("decimal(38,0)"))
    return (pairs.join(two, ["vec_id", "h"]).join(one, ["query_id", "query_h"]).filter(F.size("query_vec") == F.size("vec"))
            .groupBy("query_id", "vec_id").agg(F.max(product).alias("score")))


def search(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", query: Column | None = None, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of the largest integer inner product with each query row, exactly.

    Components are the integers ``floor(256 * x)``. Queries are the rows where
    ``query`` holds (default: ids divisible by 50); every other id is a candidate.

    1. The approximation file has a byte per component: its cell of 256, between
       borders fitted on 4,096 rows (by least hash); the least and largest value
       in each cell, over all rows, bound what a cell stands for.
    2. The file is scanned for all queries: it is dealt in parts and the queries
       in blocks, and every part meets every block in one task, which bounds the
       products and keeps, for each query, the rows whose upper bound reaches its
       k-th largest lower bound there; over all parts, that bound decides again.
    3. Whole vectors are read in order of their bounds: the 2k best of a query
       first, then those whose upper bound still reaches the k-th product found.
       What is left cannot enter the result, which is therefore certain.

    Of rows with equal vectors only the ``k + 1`` smallest ids can be among the k
    nearest of any query (equal products, ties to the smaller id), so a vector
    that a third of all rows share is searched as k + 1 rows. Rows of one id and
    different vectors are one candidate, with its best product, and one query.

    Vectors that are null or hold null or non-finite components take no part,
    nor rows without id; vectors meet only those of their length, and empty ones
    have product 0. Integers beyond +-2^53 are held there; a product beyond 64
    bits ranks exactly and shows as the nearest 64-bit number. Other columns are not read.
    """
    asked = F.pmod(F.col("id"), F.lit(50)) == 0 if query is None else query
    given = (vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
             .filter(F.col("id").isNotNull() & usable(F.col("vec"))).select("id", whole_numbers(F.col("vec")).alias("vec")))
    given = cut(given.distinct().withColumn("h", F.xxhash64("vec")))
    queries = given.filter(asked)
    copies = Window.partitionBy("vec").orderBy("id")
    rows = cut(given.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("id", "h", "vec"))
    n_rows, n_queries = rows.count(), queries.count()

    sample = rows.orderBy(F.xxhash64("id", "h"), "id", "h").limit(FIT_ROWS).select("vec").collect()
    by_dims: dict[int, list] = {}
    for r in sample:
        by_dims.setdefault(len(r.vec), []).append(r.vec)
    edges = {dims: borders(np.array(x)) for dims, x in by_dims.items() if dims}
    # 256 cells a component at most
    found = (rows.select("vec").mapInArrow(_extents(edges), "dims int, dim int, cell int, low double, high double")
             .groupBy("dims", "dim", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    extents: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in found:
        low, high = extents.setdefault(r.dims, (np.zeros((r.dims, CELLS)), np.zeros((r.dims, CELLS))))
        low[r.dim, r.cell], high[r.dim, r.cell] = r.low, r.high

    file = cut(rows.select("id", "h", "vec").mapInArrow(_approximate(edges), "id bigint, h bigint, cells binary"))
    parts = -(-n_rows // max(LEAST_PART, min(MOST_PART, n_rows // PARTS))) or 1
    blocks = -(-n_queries // MOST_QUERIES) or 1
    deal = F.xxhash64("id", "h", F.lit("part"))
    scanned = file.select(F.pmod(deal, F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qpart"),
                          F.lit(1).alias("kind"), "id", "h", "cells", F.lit(None).cast("array<double>").alias("vec"))
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(deal, F.lit(blocks)).cast("int").alias("qpart"),
                            F.lit(0).alias("kind"), "id", "h", F.lit(None).cast("binary").alias("cells"), "vec")
    possible = cut(scanned.unionByName(asking).repartition(parts * blocks, "part", "qpart").sortWithinPartitions("part", "qpart")
                   .mapInArrow(_scan(extents, k), "query_id bigint, query_h bigint, vec_id bigint, h bigint, lower double, upper double"))

    lowest = _first(possible.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower")), k, F.col("lower").desc())
    reach = lowest.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("lower")).alias("least"))
    possible = possible.join(reach, "query_id").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")
    best = cut(_first(possible, 2 * k, F.col("upper").desc(), F.col("vec_id"), F.col("h")))
    read = cut(_exact(best, queries, given))
    certain = (_first(read, k, F.col("score").desc(), F.col("vec_id")).groupBy("query_id")
               .agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")))
    rest = (possible.join(best.select("query_id", "query_h", "vec_id", "h"), ["query_id", "query_h", "vec_id", "h"], "left_anti")
            .join(certain, "query_id").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least").cast("double") * (1 - 1e-12 * F.signum(F.col("least").cast("double"))))))
    both = read.unionByName(_exact(rest, queries, given)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    most = (1 << 63) - 1
    shown = F.greatest(F.least(F.col("score"), F.lit(most).cast("decimal(38,0)")), F.lit(-most).cast("decimal(38,0)")).cast("bigint")
    return both.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", shown.alias("score"))
