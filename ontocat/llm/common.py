"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ontocat
from ontocat.session import storage_root


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, by a path that Spark resolves (local or any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Tasks import it by name, and a cluster's executors (or a driver started in
    another folder) may not have it on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ontocat_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(ontocat.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ontocat-package-"), "ontocat_package.zip")  # served by the driver
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(package)))
    sc.addPyFile(path)
    sc._ontocat_shipped = True


def shipped(job):
    """The job ``(spark, ...)``, after the package has been sent to the executors."""
    @functools.wraps(job)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return job(spark, *args)
    return run


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    ``checkpoint()`` writes to the folder of ``spark.checkpoint.dir``; a local
    session that has none gets a private folder (see ``storage_root``).
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(storage_root(spark))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other scripts too)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows of an input sorted by ``keys``; no run of equal keys is split.

    Each table holds the complete runs of what has been read since the last
    one; only the run that a batch ends in waits for the next batch. Memory is
    one batch plus the longest run.
    """
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = tuple(table[k][0].as_py() for k in keys)
        last = tuple(table[k][-1].as_py() for k in keys)
        if held and first == key and last == key:
            held.append(table)
            continue
        split = _run_start(table, keys, last)
        if split or not held or first != key:
            if held and first != key:
                yield pa.concat_tables(held)
                held = []
            if split:
                yield pa.concat_tables([*held, table.slice(0, split)])
                held = []
        held.append(table.slice(split))
        key = last
    if held:
        yield pa.concat_tables(held)


def _run_start(table: pa.Table, keys: Sequence[str], last: tuple) -> int:
    """The first row of the run that ends the table."""
    low, high = 0, table.num_rows - 1
    while low < high:  # rows of the last key are at the end, so the test is monotone
        mid = (low + high) // 2
        if tuple(table[k][mid].as_py() for k in keys) == last:
            high = mid
        else:
            low = mid + 1
    return low


#: Links per task in the rounds of ``components``, which are many and mostly small.
LINKS_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges (a, b)``.

    The label of a component is its smallest node. Rounds of large-star and
    small-star joins; a node's neighbours are never gathered, only their
    minimum, so a node with very many links stays cheap. Every round is
    checkpointed; the rounds end when the links no longer change. Rounds never
    have more links than the input has, whose number sets the number of tasks.
    """
    edges = cut(edges.filter(F.col("a") != F.col("b")).distinct())
    tasks = edges.count() // LINKS_PER_TASK + 1
    edges, seen = edges.coalesce(tasks), None
    while True:
        # large star: larger neighbours are linked to the smallest neighbour (or the node itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.filter("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").coalesce(tasks).distinct())
        # small star: smaller neighbours and the node itself are linked to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").coalesce(tasks).distinct())
        edges = cut(small.coalesce(tasks))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
