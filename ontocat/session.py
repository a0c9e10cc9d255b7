"""Session helpers: building a session for tests/bench and locating shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Shuffled bytes that adaptive execution gives one task, where it has a choice. Triples and tags sorted or hashed by name are
# so alike that they hold some 50 times their compressed size in memory; of the default, 64 MB, one task would hold gigabytes.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
# Bytes of files that one task reads, and what opening a file counts for: as many small files to a task as by default. Keys
# compress well, so of the default, 128 MB, a task makes millions of rows and holds them all to hash or to shuffle them.
SPLIT_BYTES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.files.openCostInBytes": "512k"}

# Has Spark delete the shuffle files of a query as it ends; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings every job here relies on. AQE does the runtime work the plans are
# written for: broadcast of sides that turn out small, coalescing of tiny
# shuffle partitions, and splitting of skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    TASK_BYTES[0]: TASK_BYTES[1],
    **SPLIT_BYTES,
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ontocat") -> SparkSession:
    """A local session configured like the cluster jobs (tests, bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ONTOCAT_DRIVER_MEMORY", "16g"))
    # Local runs execute many short jobs in one JVM: let the cleaner release
    # broadcast and shuffle blocks of finished queries promptly.
    builder = builder.config("spark.cleaner.periodicGC.interval", "2min")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_tasks(spark: SparkSession) -> None:
    """Have shuffles dealt by :data:`TASK_BYTES` and files by :data:`SPLIT_BYTES`, unless the session has sizes of its own."""
    own = spark.conf.getAll
    if TASK_BYTES[0] not in own:
        spark.conf.set(*TASK_BYTES)
    if next(iter(SPLIT_BYTES)) not in own:
        for key, size in SPLIT_BYTES.items():
            if key not in own:
                spark.conf.set(key, size)


def storage_root(spark: SparkSession) -> str:
    """Shared folder for snapshots and lineage cuts.

    Uses the cluster's ``spark.checkpoint.dir``. Only when it is unset and the
    session is local (tests, bench) is a private scratch folder created and
    registered as the checkpoint dir.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; no local fallback on a cluster")
    scratch = tempfile.mkdtemp(prefix="ontocat-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir().rstrip("/")


def new_snapshot_path(spark: SparkSession, kind: str) -> str:
    """A fresh, never-reused path under the shared storage root."""
    return f"{storage_root(spark)}/ontocat/{kind}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files: for steps that are written one after the other."""
    own = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, own)


def drop_snapshot(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_snapshot_path` named, once nothing reads it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Tasks that run its Python code import it by name, and a cluster's executors
    (or a driver started in another folder) may not have it on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ontocat_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ontocat-package-"), "ontocat_package.zip")  # served by the driver
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(package)))
    sc.addPyFile(path)
    sc._ontocat_shipped = True
