"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ontocat.llm.common import cut, sorted_runs

K = 10
TABLES = 8
#: Signed axes that a query looks up in each table, of 2 x dimension.
PROBES = 20
SEED = 7
#: Rows of a bucket, and queries, that one task compares at a time.
CHUNK_ROWS = 16_384
CHUNK_QUERIES = 2_048

_ROW = "bucket bigint, part int, qpart int, kind int, id bigint, vec array<double>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (its length a power of two) in n log n steps."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


def rotations(vectors: np.ndarray, tables: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Unit vectors under each table's pseudo-rotation H D3 H D2 H D1 (D: random signs), padded to a power of two."""
    n, dim = vectors.shape
    size = 1 << max(0, dim - 1).bit_length()
    unit = np.zeros((n, size))
    top = np.abs(vectors).max(axis=1, keepdims=True)  # scaled first, so that squares neither overflow nor vanish
    scaled = vectors / top
    unit[:, :dim] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    for table in range(tables):
        signs = np.random.default_rng([seed, table, size]).choice([-1.0, 1.0], (3, size))
        turned = unit
        for sign in signs:
            turned = hadamard(turned * sign)
        yield turned


def axes(turned: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: axis i as 2i, its opposite as 2i + 1."""
    both = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _codes(tables: int, probes: int):
    """Bucket numbers of each vector: ``tables`` groups of ``probes`` signed axes; dimension and table are part of the number."""
    @arrow_udf("array<bigint>")
    def codes(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in vectors:
            lists = chunk.to_pylist()
            out: list = [None] * len(lists)
            by_dim: dict[int, list[int]] = {}
            for at, v in enumerate(lists):
                by_dim.setdefault(len(v), []).append(at)
            for dim, rows in by_dim.items():
                x = np.array([lists[r] for r in rows])
                found = [(dim * tables + t) * (1 << 20) + axes(turned, probes)
                         for t, turned in enumerate(rotations(x, tables))]
                for r, code in zip(rows, np.concatenate(found, axis=1).tolist()):
                    out[r] = code
            yield pa.array(out, pa.list_(pa.int64()))
    return codes


def usable(vec: Column) -> Column:
    """Not null, not zero, no null, NaN or infinite component."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.exists(vec, lambda v: v != 0) & ~bad, F.lit(False))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, for components of any size.

    Gaps are scaled by a power of two per row, which changes no digit, so that
    their squares neither overflow nor vanish; a distance beyond the largest
    double is infinite.
    """
    halves = rows * 0.5 - query * 0.5 if max(np.abs(rows).max(initial=0), np.abs(query).max(initial=0)) > 2.0 ** 1000 else None
    gaps = rows - query if halves is None else halves
    power = np.frexp(np.abs(gaps).max(axis=1, initial=0))[1]
    gaps = np.ldexp(gaps, -power[:, None])
    with np.errstate(over="ignore"):
        return np.ldexp(np.sqrt((gaps * gaps).sum(axis=1)), power + (halves is not None))


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """Exact ``(query, id, distance)`` of the k nearest rows of each query, without the query's own id; ties to the smaller id."""
    out = []
    # scaled by a power of two, so that no square overflows; what vanishes is within the slack
    top = -int(np.frexp(max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)))[1])
    scaled, asked = np.ldexp(rows, top), np.ldexp(queries, top)
    norms = (scaled * scaled).sum(axis=1)
    rough = norms[None] - 2 * asked @ scaled.T
    slack = 1e-9 * (np.abs(norms).max() + (asked * asked).sum(axis=1).max())
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, ids[by_id][1:] != ids[by_id][:-1]])  # the first row of each id
    for q, near in enumerate(rough):
        near[ids == query_ids[q]] = np.inf
        close = np.flatnonzero(np.isfinite(near))
        if len(close) > k:
            each = near if len(starts) == len(ids) else np.minimum.reduceat(near[by_id], starts)
            each = each[np.isfinite(each)]
            if len(each) > k:
                close = close[near[close] <= np.partition(each, k - 1)[k - 1] + slack]
        exact = distances(rows[close], queries[q])
        best: dict[int, float] = {}
        for at in np.lexsort((ids[close], exact)):  # a repeated id counts once, with its nearest row
            if len(best) == k:
                break
            best.setdefault(int(ids[close[at]]), float(exact[at]))
        out += [(int(query_ids[q]), vec, gap) for vec, gap in best.items()]
    return out


def _compare(k: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["bucket", "part", "qpart"]):
            key = np.stack([table[c].to_numpy() for c in ("bucket", "part", "qpart")])
            kind, ids = table["kind"].to_numpy(), table["id"].to_numpy()
            values = table["vec"].combine_chunks()
            flat, offsets = values.flatten().to_numpy(), None
            offsets = values.offsets.to_numpy() - values.offsets[0].as_py()
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
            found: list[tuple] = []
            for a, z in zip(starts[:-1], starts[1:]):
                split = a + int((kind[a:z] == 0).sum())  # queries are sorted before rows
                if a < split < z:
                    x = flat[offsets[a]:offsets[z]].reshape(z - a, -1)
                    found += nearest(x[:split - a], ids[a:split], x[split - a:], ids[split:z], k)
            if found:
                q, v, d = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())],
                                                 ["query_id", "vec_id", "score"])
    return compare


def _probe(queries: DataFrame, rows: DataFrame, tables: int, probes: int, k: int) -> DataFrame:
    """Exact distances of the k nearest rows of each query in each of its buckets."""
    keyed = rows.select("id", "vec", F.explode(_codes(tables, 1)("vec")).alias("bucket"))
    asked = queries.select("id", "vec", F.explode(_codes(tables, probes)("vec")).alias("bucket"))
    # one row per bucket: tables x 2 x dimension of them, whatever the input
    sizes = (keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
             .join(asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("q")), "bucket")
             .select("bucket", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("parts"),
                     F.ceil(F.col("q") / CHUNK_QUERIES).cast("int").alias("qparts")))

    def dealt(frame: DataFrame, kind: int) -> DataFrame:
        """Each row in one part of its bucket, with every part of the other kind."""
        own, other = ("parts", "qparts") if kind else ("qparts", "parts")
        mine = F.pmod(F.xxhash64("id", "vec"), F.col(own)).cast("int")  # rows of one id are dealt too
        frame = frame.join(F.broadcast(sizes), "bucket").withColumn("own", mine).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        part, qpart = ("own", "other") if kind else ("other", "own")
        return frame.select("bucket", F.col(part).alias("part"), F.col(qpart).alias("qpart"), F.lit(kind).alias("kind"), "id", "vec")

    return (dealt(keyed, 1).unionByName(dealt(asked, 0)).repartition("bucket", "part", "qpart")
            .sortWithinPartitions("bucket", "part", "qpart", "kind")
            .mapInArrow(_compare(k), "query_id bigint, vec_id bigint, score double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all its buckets; a row found in several of them counts once."""
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(first).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", query: Column | None = None, k: int = K,
           tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query row, by Euclidean distance.

    Queries are the rows where ``query`` holds (default: ids divisible by 100).
    Every row is hashed into one bucket per table, the signed axis nearest to
    its rotated unit vector; a query looks up its ``probes`` nearest axes in
    each table. Buckets are compared in parts of bounded size, so a hot bucket
    (one vector repeated very often) is shared by many tasks; each part hands on
    the k nearest of a query with distances exact in double precision. A query
    that has found fewer than ``k`` rows goes on to all axes of one table, which
    hold every row, so small tables give all candidates there are.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor rows without id; vectors are only compared with those of
    their length. A repeated id is one candidate, with its nearest row; a
    query's own id is never its candidate, and repeated query rows are searched
    as one, the nearest distance counting. Rows equal in id and vector are made
    one before hashing; other rows of one id are dealt like those of any other. Other columns are not read.
    """
    asked = F.pmod(F.col("id"), F.lit(100)) == 0 if query is None else query
    rows = (vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & usable(F.col("vec"))).distinct())
    queries = rows.filter(asked)
    done = cut(_best(_probe(queries, rows, tables, probes, k), k))  # at most k rows per query
    full = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = cut(queries.join(full, queries["id"] == full["query_id"], "left_anti"))
    if short.isEmpty():
        return done
    dims = short.agg(F.max(F.size("vec"))).first()[0]
    every = 2 << max(0, dims - 1).bit_length()
    more = _best(_probe(short, rows, 1, every, k), k)
    return done.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)


def recall(found: DataFrame, vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", k: int = K) -> float:
    """Share of the true k nearest that ``found`` has, for its queries, by comparing them with all rows in blocks.

    For tests and tuning: every task compares its rows with a broadcast block of
    the queries, which the caller keeps small.
    """
    rows = (vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & usable(F.col("vec"))))
    asked = rows.join(found.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").collect()
    ids, x = np.array([r.id for r in asked]), np.array([r.vec for r in asked])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(nearest(x, ids, np.array(frame["vec"].tolist()), frame["id"].to_numpy(), k),
                               columns=["query_id", "vec_id", "score"])

    true = _best(rows.mapInPandas(scan, "query_id bigint, vec_id bigint, score double"), k)
    hits = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, true.count())
