"""Graph store (S1): open a stored graph, write snapshots.

A graph snapshot is parquet partitioned by storage key. Plain parquet has no
MERGE and Spark cannot overwrite a path it is reading, so every mutation writes
a *new* snapshot path, holding the partitions it touched and referring to the
others; the old one stays readable until dropped.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontocat.model import PK, TRIPLE_COLUMNS, TRIPLE_SCHEMA, empty_graph, storage_key
from ontocat.session import new_snapshot_path

STORED_SCHEMA = T.StructType(list(TRIPLE_SCHEMA.fields) + [T.StructField(PK, T.StringType(), True)])
MANIFEST = "_manifest"
#: Triples of one writing task, on average. Ranges of sorted triples compress so well that their bytes tell little of what a task holds.
TASK_ROWS = 400_000


def _key() -> Column:
    return storage_key(F.col("p"), F.col("o"), F.col("o_kind"))


def open_graph(spark: SparkSession, path: str | None, create: bool = False) -> DataFrame:
    """Read a stored graph. ``None`` is the empty graph; a path without one is an error
    unless ``create``, when it is the empty graph too.

    A snapshot is either one folder of partitions or a manifest that names, for
    every partition, the folder it lies in (see :func:`write_changed`).
    """
    if path is None:
        return empty_graph(spark).withColumn(PK, _key())
    folders = _folders(spark, path)
    if folders is None:
        try:
            return spark.read.schema(STORED_SCHEMA).parquet(path)
        except AnalysisException as exc:
            if create and exc.getCondition() == "PATH_NOT_FOUND":
                return empty_graph(spark).withColumn(PK, _key())
            raise
    parts = [spark.read.schema(STORED_SCHEMA).parquet(root).filter(F.col(PK).isin(*keys)) for root, keys in folders.items()]
    out = parts[0] if parts else empty_graph(spark).withColumn(PK, _key())
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _folders(spark: SparkSession, path: str) -> dict[str, list[str]] | None:
    """Folder -> partitions of a manifest snapshot (a row per partition: some 40); None for a plain folder."""
    try:
        rows = spark.read.schema("folder string, key string").json(f"{path}/{MANIFEST}").collect()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    out: dict[str, list[str]] = {}
    for r in sorted(map(tuple, rows)):
        out.setdefault(r[0], []).append(r[1])
    return out


def write_graph(g: DataFrame, path: str, dedupe: bool = False) -> str:
    """Write ``g`` as a snapshot partitioned by :func:`storage_key`.

    Range partitioning on (pk, s, o) gives each task one or two partition
    folders and a narrow subject range per file, so the parquet statistics on
    ``s`` make point look-ups cheap, and spreads a subject with very many
    objects. ``dedupe=True`` enforces set semantics on the way: duplicates share
    (pk, s, o), so the distinct needs no shuffle of its own. The number of tasks
    grows with the number of triples (:data:`TASK_ROWS`), so what a task holds
    does not.
    """
    tasks = max(1, math.ceil(g.count() / TASK_ROWS))
    out = g.select(*TRIPLE_COLUMNS).withColumn(PK, _key()).repartitionByRange(tasks, PK, "s", "o")
    if dedupe:
        out = out.distinct()
    out.sortWithinPartitions(PK, "s", "o").write.mode("errorifexists").partitionBy(PK).parquet(path)
    return path


def write_changed(spark: SparkSession, old_path: str | None, changed: DataFrame, path: str, touched: list[str]) -> str:
    """Write a snapshot in which only the ``touched`` partitions are new (``changed``, their whole content).

    The others are referenced where they lie, so a small batch of changes costs
    the partitions it touches and not the graph. Snapshots that others refer to
    must be kept; :func:`write_graph` makes a self-contained copy.
    """
    old = {}
    if old_path is not None:
        old = _folders(spark, old_path)
        if old is None:
            present = [r[0] for r in spark.read.schema(STORED_SCHEMA).parquet(old_path).select(PK).distinct().collect()]
            old = {old_path: present}
    rows = [(folder, key) for folder, keys in old.items() for key in keys if key not in touched]
    if touched:
        write_graph(changed, f"{path}/changed")
        rows += [(f"{path}/changed", key) for key in touched]
    spark.createDataFrame(rows, "folder string, key string").coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return path


def snapshot(spark: SparkSession, g: DataFrame, kind: str = "graph") -> DataFrame:
    """Materialise ``g`` to a fresh path in the shared folder and re-open it.

    This cuts lineage (the result no longer depends on the inputs' plans) and
    survives executor loss, unlike a cache or a local checkpoint.
    """
    path = new_snapshot_path(spark, kind)
    write_graph(g, path)
    return open_graph(spark, path)
