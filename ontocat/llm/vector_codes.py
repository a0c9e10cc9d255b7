"""Vector code compression: product codes whose codebooks come from Lloyd rounds over cover trees."""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontocat.llm.common import cut
from ontocat.operators.joins import broadcast_if_bounded

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows that share their trees; a tree is built of their distinct parts.
TREE_ROWS = 2048
#: A node's children lie at least this share of its radius apart; nodes of few points are not divided.
SHRINK = 0.6
LEAF = 4
#: Relative slack of bounds in floating point.
SLACK = 1e-9


def limit(dims: int) -> int:
    """The largest size of an integer component for which the squared distance of whole vectors fits 64 bits."""
    return math.isqrt(((1 << 61) - 1) // max(1, dims))


def whole_numbers(vectors: list, dims: int, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of each component, zeros behind shorter vectors, held within :func:`limit`."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    most = limit(dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -most, most).astype(np.int64)


def gaps(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries, as floats where those are exact and as integers beyond."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 52:
        x, y = points.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], axis=1)


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree of distinct points, level after level from the root.

    Each node has a center, the largest distance of its points from it, and a
    range of the order of ``members`` (point numbers), in which its points lie
    next to each other; ``kids`` holds the range of its children's numbers
    (empty for a leaf). Children are picked farthest first until every point
    lies within ``SHRINK`` of the radius of one.
    """
    members = np.arange(len(points))
    centers, radii, starts, stops, kids = [0], [0.0], [0], [len(points)], []
    far = np.sqrt(gaps(points, points[:1])[:, 0].astype(np.float64))
    radii[0] = float(far.max(initial=0.0))
    at = 0
    while at < len(centers):
        start, stop, radius = starts[at], stops[at], radii[at]
        if stop - start <= LEAF or radius == 0.0:
            kids.append((len(centers), len(centers)))
            at += 1
            continue
        own = members[start:stop].copy()
        x = points[own]
        place = int(np.flatnonzero(own == centers[at])[0])
        nearest = np.sqrt(gaps(x, x[place:place + 1])[:, 0].astype(np.float64))
        of = np.zeros(len(own), np.int64)
        picked = [place]
        while True:
            next_one = int(np.argmax(nearest))
            if nearest[next_one] <= SHRINK * radius:
                break
            d = np.sqrt(gaps(x, x[next_one:next_one + 1])[:, 0].astype(np.float64))
            closer = d < nearest
            of[closer] = len(picked)
            nearest[closer] = d[closer]
            picked.append(next_one)
        order = np.argsort(of, kind="stable")
        members[start:stop] = own[order]
        sizes = np.bincount(of, minlength=len(picked))
        first = len(centers)
        edges = start + np.r_[0, np.cumsum(sizes)]
        far = np.maximum.reduceat(nearest[order], edges[:-1] - start)
        centers += own[picked].tolist()
        radii += far.tolist()
        starts += edges[:-1].tolist()
        stops += edges[1:].tolist()
        kids.append((first, len(centers)))
        at += 1
    return {"centers": np.array(centers, np.int64), "radii": np.array(radii), "starts": np.array(starts, np.int64),
            "stops": np.array(stops, np.int64), "kids": np.array(kids, np.int64).reshape(-1, 2), "members": members}


def assign(points: np.ndarray, tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Which entry is nearest: ``(nodes, entries)`` of subtrees assigned whole, and ``(places, entries)`` of points compared one by one.

    If a node's center is nearer to its first entry than to its second by more
    than twice the radius, that entry is the nearest of all its points, and the
    only one. Other nodes hand on to their children; the points of undivided
    nodes are compared exactly, ties going to the lower entry.
    """
    nodes, node_entries, places, place_entries = [], [], [], []
    front = np.zeros(min(1, len(points)), np.int64)
    while len(front):
        d = gaps(points[tree["centers"][front]], entries)
        first, radius = np.argmin(d, axis=1), tree["radii"][front]
        sure = radius == 0.0  # one point: its own distances decide
        if len(entries) > 1:
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
            sure |= two[:, 0] + 2 * radius < two[:, 1] - SLACK * (two[:, 1] + radius)
        else:
            sure[:] = True
        nodes.append(front[sure])
        node_entries.append(first[sure])
        kids = tree["kids"][front[~sure]]
        undivided = kids[:, 0] == kids[:, 1]
        leaves = front[~sure][undivided]
        if len(leaves):
            spots = np.concatenate([np.arange(a, z) for a, z in zip(tree["starts"][leaves], tree["stops"][leaves])])
            places.append(spots)
            place_entries.append(np.argmin(gaps(points[tree["members"][spots]], entries), axis=1))
        front = np.concatenate([np.arange(a, z) for a, z in kids[~undivided]] or [front[:0]])
    none = np.zeros(0, np.int64)
    return ((np.concatenate(nodes or [none]), np.concatenate(node_entries or [none])),
            (np.concatenate(places or [none]), np.concatenate(place_entries or [none])))


def _packed(x: np.ndarray) -> bytes:
    """The trees of one block of rows (integer vectors ``x``): one per part, with cumulative sums of its points in tree order."""
    width, out = x.shape[1] // PARTS, {}
    for part in range(PARTS):
        points, row, weights = np.unique(x[:, part * width:(part + 1) * width], axis=0, return_inverse=True, return_counts=True)
        tree = cover_tree(points)
        order = tree["members"]
        counts = np.r_[0, np.cumsum(weights[order])]
        sums = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(weights[order][:, None] * points[order], axis=0)])
        out |= {f"{part} {k}": v for k, v in (tree | {"points": points, "row": row.reshape(-1), "counts": counts, "sums": sums}).items()}
    packed = io.BytesIO()
    np.savez(packed, **out)
    return packed.getvalue()


def _trees(blob: bytes) -> list[dict[str, np.ndarray]]:
    with np.load(io.BytesIO(blob)) as held:
        names = {k.split()[1] for k in held}
        return [{n: held[f"{part} {n}"] for n in names} for part in range(PARTS)]


def _grow(dims: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                block = batch.slice(at, TREE_ROWS)
                packed = _packed(whole_numbers(block.column(1).to_pylist(), dims))
                edges = pa.array([0, block.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, block.column(0)), pa.ListArray.from_arrays(edges, block.column(2)),
                                                  pa.array([packed], pa.binary())], ["ids", "labels", "trees"])
    return grow


def _round(codebooks: list[np.ndarray]):
    """How many points each entry has, and their sum, over the trees of a task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros(c.shape, object) for c in codebooks]  # of any size
        for batch in batches:
            for blob in batch.column(0):
                for part, tree in enumerate(_trees(blob.as_py())):
                    (nodes, whole), (places, single) = assign(tree["points"], tree, codebooks[part])
                    starts, stops = np.r_[tree["starts"][nodes], places], np.r_[tree["stops"][nodes], places + 1]
                    entry = np.r_[whole, single]
                    np.add.at(counts[part], entry, tree["counts"][stops] - tree["counts"][starts])
                    block = np.zeros(codebooks[part].shape, np.int64)
                    np.add.at(block, entry, tree["sums"][stops] - tree["sums"][starts])
                    sums[part] += block
        rows = [(part, e, int(counts[part][e]), [str(v) for v in sums[part][e]])
                for part in range(PARTS) for e in range(len(codebooks[part])) if counts[part][e]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))],
                                             ["part", "entry", "n", "sums"])
    return add


def _encode(codebooks: list[np.ndarray]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blob in zip(*batch.columns):
                codes, error = [], 0
                for part, tree in enumerate(_trees(blob.as_py())):
                    (nodes, whole), (places, single) = assign(tree["points"], tree, codebooks[part])
                    entry = np.zeros(len(tree["points"]), np.int64)  # by place in the tree's order
                    for a, z, e in zip(tree["starts"][nodes], tree["stops"][nodes], whole):
                        entry[a:z] = e
                    entry[places] = single
                    of_point = np.empty_like(entry)
                    of_point[tree["members"]] = entry
                    gap = ((tree["points"] - codebooks[part][of_point]) ** 2).sum(axis=1)
                    codes.append(of_point[tree["row"]])
                    error = error + gap[tree["row"]]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(["".join(f"{e:02x}" for e in row) for row in zip(*codes)], pa.string()),
                     pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
    return encode


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of every usable vector, and the codebooks, one integer array per part.

    Components are the integers ``floor(4096 * x)``; a vector is cut into 8
    equal consecutive parts. Each part's codebook starts as that part of the
    ``entries`` rows of the smallest ids; each round replaces every entry by the
    floored mean of the parts nearest to it (ties: the lower entry), unused
    entries stay. ``code`` has two hex digits a part, ``error`` is the squared
    distance to the coded vector.

    Rows are taken as they lie, in blocks of 2,048; every block and part gets
    a cover tree of its distinct parts with their weights, so copies cost
    nothing. The trees are written once, to the checkpoint folder; a round reads
    them, assigns whole subtrees by their cumulative sums where the triangle
    inequality allows it, compares the other points exactly, and sends on 8 x
    ``entries`` sums a task. The driver gets the sums of each entry: as many
    numbers as the codebooks have.

    Rows whose vector is null or holds a null, NaN or infinite component are
    dropped. Vectors shorter than the longest (rounded up to a multiple of 8) get
    zeros behind, which changes no distance between equally long ones; integers
    are held within +-2^30.5 / sqrt(length), beyond which errors leave 64 bits.
    Null ids come after all others; rows of one id are rows like others, in order of their vectors.
    With fewer rows than ``entries`` the codebooks are that short. Other columns are not read.
    """
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = (vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"), F.col(label).alias("label"))
            .filter(F.col("vec").isNotNull() & ~bad))
    label_type = kept.schema["label"].dataType.simpleString()
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    dims = max(PARTS, -(-longest // PARTS) * PARTS)
    width = dims // PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    start = whole_numbers([r.vec for r in first], dims)
    codebooks = [start[:, part * width:(part + 1) * width].copy() for part in range(PARTS)]
    if not first:
        return vectors.sparkSession.createDataFrame([], f"vec_id bigint, label {label_type}, code string, error bigint"), codebooks
    trees = cut(kept.select("vec_id", "vec", "label").mapInArrow(_grow(dims), f"ids array<bigint>, labels array<{label_type}>, trees binary"))
    for _ in range(rounds):
        found = trees.select("trees").mapInArrow(_round(codebooks), "part int, entry int, n bigint, sums array<string>")
        means = (found.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())
        for m in means:
            codebooks[m.part][m.entry, m.at] = int(m.x) // m.n
    return trees.mapInArrow(_encode(codebooks), f"vec_id bigint, label {label_type}, code string, error bigint"), codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, separated by commas."""
    return hashlib.sha256(",".join(str(v) for book in codebooks for entry in book for v in entry).encode()).hexdigest()


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: :func:`compress` with the error of all rows of equal label.

    Null labels are one label. An error sum beyond 64 bits is held at the largest. Errors are summed in the
    tasks first; the sums, one row per label, are broadcast if they are few and joined by shuffle if not.
    """
    coded, codebooks = compress(vectors, **options)
    coded = cut(coded)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("bigint").alias("label_error"))
    side = broadcast_if_bounded(sums.withColumnRenamed("label", "of"))
    return coded.join(side, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
