"""Tag changes applied to a catalog once and in order, however often the job is started.

A change table is cut into chunks by a hash of (entity, tag, step): an entity
with very many changes is spread over many chunks, and a chunk is the same rows
in every run. Spark writes the chunks through a Python data source, all deletes
before the first add, since a catalog limits the tags of an object. A task

1. asks the target which changes of a chunk are not in effect yet,
2. applies those,
3. enters the chunk in the journal: one small file, made complete or not at all.

A run that was stopped anywhere is started again with the same journal. Chunks
entered are not touched; of a chunk that was begun, only what is missing is
applied. So a change is made once, unless two attempts of one task run at the
same moment (speculative execution), which a target of set operations survives.
A journal belongs to one change table and refuses another.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ontocat.operators.joins import broadcast_if_bounded
from ontocat.session import ship_package

KEY = ["entity_type", "entity_name", "tag_key"]
DELETE, ADD = 0, 1
#: Changes of a chunk, on average: what a stopped task may have to ask the target about.
CHUNK_ROWS = 2_000
#: Most chunks that one task is given.
TASK_CHUNKS = 16

#: (entity_type, entity_name, tag_key)
Change = tuple[str, str, str]


class TagTarget(Protocol):
    """Where changes take effect; sent to the tasks. ``chunk`` names the same changes in every run."""

    def missing(self, chunk: str, step: int, changes: Sequence[Change]) -> Sequence[Change]:
        """The changes that are not in effect yet."""

    def apply(self, chunk: str, step: int, changes: Sequence[Change]) -> None:
        """Put changes into effect; may die at any place."""


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _write_whole(path: str, data: bytes) -> None:
    """A file that is there complete or not at all; written again, it is the same."""
    fs, name = _folder(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    draft = f"{os.path.dirname(name)}/_draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, name)


def _exists(path: str) -> bool:
    fs, name = _folder(path)
    return fs.get_file_info(name).type == pafs.FileType.File


@dataclass
class FolderTarget:
    """Tags as a table of a shared folder: the tags at first, and files of changes numbered by their plan."""

    root: str
    plan: int

    def _file(self, chunk: str, step: int) -> str:
        return f"{self.root}/changes/plan={self.plan}/step={step}/{chunk}.parquet"

    def missing(self, chunk, step, changes):
        return [] if _exists(self._file(chunk, step)) else changes

    def apply(self, chunk, step, changes):
        out = pa.BufferOutputStream()
        pq.write_table(pa.table({c: pa.array(v, pa.string()) for c, v in zip(KEY, zip(*changes))}), out)
        _write_whole(self._file(chunk, step), out.getvalue().to_pybytes())

    @staticmethod
    def start(tags: DataFrame, root: str) -> None:
        tags.select(*KEY).write.mode("errorifexists").parquet(f"{root}/first")

    @staticmethod
    def tags(spark: SparkSession, root: str) -> DataFrame:
        """The tags now: of each key the last change, or that it was there at first, by one aggregate."""
        first = spark.read.parquet(f"{root}/first").select(*KEY, F.struct(F.lit(-1).alias("plan"), F.lit(ADD).alias("step")).alias("event"))
        if _folder(f"{root}/changes")[0].get_file_info(_folder(f"{root}/changes")[1]).type == pafs.FileType.NotFound:
            return first.select(*KEY).distinct()
        schema = ", ".join(f"{c} string" for c in KEY) + ", plan int, step int"
        changed = spark.read.schema(schema).parquet(f"{root}/changes").select(*KEY, F.struct("plan", "step").alias("event"))
        return (first.unionByName(changed).groupBy(*KEY).agg(F.max("event").alias("event"))
                .filter(F.col("event.step") == ADD).select(*KEY))


@dataclass
class Applied(WriterCommitMessage):
    """What one task did."""

    chunks: int
    changes: int


def _source(name: str, target: TagTarget, journal: str) -> type[DataSource]:
    """A data source whose writer applies rows ``(step, chunk, *KEY)``, those of a chunk behind each other."""

    class TagWriter(DataSourceWriter):
        def write(self, iterator: Iterator[Row]) -> Applied:
            done = Applied(0, 0)
            for (step, chunk), rows in groupby(iterator, key=lambda r: (r["step"], r["chunk"])):
                changes = [tuple(r[c] for c in KEY) for r in rows]
                missing = target.missing(chunk, step, changes)
                if missing:
                    target.apply(chunk, step, missing)
                _write_whole(f"{journal}/done/step={step}/{chunk}.json", json.dumps({"chunk": chunk, "changes": len(changes), "made": len(missing)}).encode())
                done = Applied(done.chunks + 1, done.changes + len(missing))
            return done

        def commit(self, messages) -> None:
            told = [m for m in messages if m is not None]
            _write_whole(f"{journal}/runs/{uuid.uuid4().hex}.json", json.dumps(
                {"chunks": sum(m.chunks for m in told), "changes": sum(m.changes for m in told)}).encode())

        def abort(self, messages) -> None:
            """Nothing is taken back: the journal holds what was done, and the next run goes on from there."""

    class TagSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite):
            return TagWriter()

    return TagSource


def apply_changes(changes: DataFrame, target: TagTarget, journal: str) -> DataFrame:
    """Apply a change table ``(entity_type, entity_name, tag_key, step)``; returns the journal's chunks ``(step, chunk, changes, made)``.

    ``changes`` must be stored (it is read once a step) and the same in every run
    of a journal. Repeated rows are one change; a row with a null in its key is
    none. An empty table makes an empty journal.
    """
    spark = changes.sparkSession
    ship_package(spark)
    rows = changes.dropna(subset=[*KEY, "step"]).select("step", *KEY).distinct()
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("step", *KEY).cast("decimal(38,0)")), F.lit(0)).alias("hash")).first()
    table = {"changes": seen["n"], "hash": str(seen["hash"]), "chunks": max(1, math.ceil(seen["n"] / CHUNK_ROWS))}
    told = f"{journal}/table.json"
    if _exists(told):
        fs, name = _folder(told)
        with fs.open_input_stream(name) as f:
            own = json.loads(f.read())
        if (own["changes"], own["hash"]) != (table["changes"], table["hash"]):
            raise ValueError(f"the journal {journal} belongs to another change table")
        table = own  # its number of chunks, too
    else:
        _write_whole(told, json.dumps(table).encode())
    fs, name = _folder(f"{journal}/done")
    fs.create_dir(name, recursive=True)

    chunk = F.format_string("%08x", F.pmod(F.xxhash64(*KEY), F.lit(table["chunks"])))
    source = f"tag_changes_{uuid.uuid4().hex}"
    spark.dataSource.register(_source(source, target, journal))
    for step in (DELETE, ADD):
        entered = broadcast_if_bounded(journal_chunks(spark, journal).filter(F.col("step") == step).select("chunk"))
        todo = rows.filter(F.col("step") == step).withColumn("chunk", chunk).join(entered, "chunk", "left_anti")
        tasks = max(1, math.ceil(table["chunks"] / TASK_CHUNKS))
        (todo.select(F.col("step").cast("int").alias("step"), "chunk", *KEY).repartition(tasks, "chunk").sortWithinPartitions("chunk", *KEY)
         .write.format(source).mode("append").save())
    return journal_chunks(spark, journal)


def journal_chunks(spark: SparkSession, journal: str) -> DataFrame:
    """The chunks that a journal holds: ``(step, chunk, changes, made)``, ``made`` those that its last attempt had to apply."""
    return (spark.read.schema("chunk string, changes bigint, made bigint, step int").json(f"{journal}/done")
            .select("step", "chunk", "changes", "made"))
