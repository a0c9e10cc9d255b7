"""A graph as a log of numbered snapshots (S1), for writers that run at the same time.

Every commit is one small file, ``log/<number>.json``, created atomically: it
names, for each storage partition, the folder that holds it, and which
partitions the commit has read and written. Data folders are never changed. A
writer plans on the newest snapshot, writes the partitions that it touches to a
folder of its own, and publishes the next number. If another writer was first:

* commits in between that wrote none of the partitions this one has read or
  written change nothing for it; it publishes on top of them;
* otherwise it is planned again on the newest snapshot.

So the graph is always what the commits give one after another, in the order of
their numbers. A number is claimed by a link or rename that fails if the file
is there, as HDFS and local file systems have it; a store without that (plain
object storage) needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontocat.model import PK, TRIPLE_COLUMNS, Vocab, class_key, empty_graph
from ontocat.operators.mutations import ChangeSet
from ontocat.sources.store import STORED_SCHEMA, write_graph

#: All partitions, as what a commit has read.
EVERYTHING = "*"
#: Partitions that the planner of a command reads beside those that it writes.
READS = {
    "register-tables": (class_key(Vocab.TABLE),), "register-columns": (class_key(Vocab.COLUMN),),
    "register-inventory": (class_key(Vocab.TABLE), class_key(Vocab.COLUMN)), "delete-objects": (EVERYTHING,),
}


class Conflict(RuntimeError):
    """A commit was overtaken more often than it may be planned."""


@dataclass(frozen=True)
class Entry:
    """A commit: its number, partition -> folder, the partitions read and written, and a note."""

    number: int
    folders: dict[str, str]
    read: tuple[str, ...] = ()
    wrote: tuple[str, ...] = ()
    note: str = ""

    def meets(self, keys: Collection[str]) -> bool:
        """Whether it has written what a commit with these partitions has seen."""
        return bool(self.wrote) and (EVERYTHING in keys or not set(keys).isdisjoint(self.wrote))


class GraphLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, number: int) -> str:
        return f"{self.root}/log/{number:020d}.json"

    def entry(self, number: int) -> Entry:
        row = (self.spark.read.schema("number bigint, folders map<string,string>, read array<string>, wrote array<string>, note string")
               .json(self._file(number)).first())
        return Entry(row.number, dict(row.folders), tuple(row.read), tuple(row.wrote), row.note)

    def latest(self) -> Entry:
        """The newest commit; before the first, an empty graph with number -1."""
        numbers = self._numbers()
        return self.entry(numbers[-1]) if numbers else Entry(-1, {})

    def open(self, number: int | None = None) -> DataFrame:
        """The graph as of a commit (default: the newest)."""
        return self._graph(self.latest() if number is None else self.entry(number))

    def _graph(self, entry: Entry) -> DataFrame:
        by_folder: dict[str, list[str]] = {}
        for key, folder in sorted(entry.folders.items()):
            by_folder.setdefault(folder, []).append(key)
        out = empty_graph(self.spark).withColumn(PK, F.lit(None).cast("string")) if not by_folder else None
        for folder, keys in by_folder.items():
            part = self.spark.read.schema(STORED_SCHEMA).parquet(f"{self.root}/data/{folder}").filter(F.col(PK).isin(*keys))
            out = part if out is None else out.unionByName(part)
        return out

    def _publish(self, entry: Entry) -> bool:
        """Create the entry's file with all its content, unless its number is taken."""
        text = json.dumps({"number": entry.number, "folders": entry.folders, "read": entry.read, "wrote": entry.wrote, "note": entry.note})
        whole, final = self._path(f"{self.root}/log/.{uuid.uuid4().hex}"), self._path(self._file(entry.number))
        out = self._fs.create(whole, False)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(whole.toUri().getPath(), final.toUri().getPath())
                return True
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(whole, final, options)
            return True
        except FileExistsError:
            return False
        except Exception as exc:  # what another store says is known only by the file being there
            if "FileAlreadyExists" in str(exc):
                return False
            raise
        finally:
            self._fs.delete(whole, False)

    def start(self, g: DataFrame, note: str = "start") -> Entry:
        """The first commit: all of ``g``. The log must be empty."""
        folder = uuid.uuid4().hex
        write_graph(g.select(*TRIPLE_COLUMNS), f"{self.root}/data/{folder}")
        keys = self._written(folder)
        entry = Entry(0, dict.fromkeys(keys, folder), (), tuple(keys), note)
        if self._numbers() or not self._publish(entry):
            raise Conflict("the log has begun already")
        return entry

    def _written(self, folder: str) -> list[str]:
        stored = self.spark.read.schema(STORED_SCHEMA).parquet(f"{self.root}/data/{folder}")
        return sorted(r[0] for r in stored.select(PK).distinct().collect())  # some 40 at most

    def commit(self, plan: Callable[[DataFrame], ChangeSet], reads: Collection[str] = (), note: str = "", attempts: int = 20) -> Entry:
        """Apply the change set that ``plan`` makes of the newest graph, as the next commit.

        ``reads`` names the partitions that the plan looks at beside those it
        changes (``READS``, or ``EVERYTHING``). A change that touches no
        partition makes no commit. ``plan`` is called again when a commit in
        between has written what this one has seen, ``attempts`` times at most.
        """
        for _ in range(attempts):
            at = self.latest()
            g = self._graph(at)
            change = plan(g)
            touched = change.touched(g)
            if not touched:
                return at
            folder = uuid.uuid4().hex
            write_graph(change.apply(g.filter(F.col(PK).isin(*touched))), f"{self.root}/data/{folder}")
            seen = {*reads, *touched}
            while at is not None:
                folders = {k: f for k, f in at.folders.items() if k not in touched} | dict.fromkeys(touched, folder)
                entry = Entry(at.number + 1, folders, tuple(sorted(seen)), tuple(touched), note)
                if self._publish(entry):
                    return entry
                at = self._overtaken(at, seen)
        raise Conflict(f"overtaken {attempts} times")

    def _overtaken(self, at: Entry, seen: Collection[str]) -> Entry | None:
        """The newest commit, if none after ``at`` has written what was seen; else None. Missing numbers may have."""
        numbers = [n for n in self._numbers() if n > at.number]
        if numbers != list(range(at.number + 1, at.number + 1 + len(numbers))):
            return None
        newer = [self.entry(n) for n in numbers]
        return None if any(e.meets(seen) for e in newer) else newer[-1] if newer else at

    def remove_unreferenced(self, keep: int = 1, min_age: float = 86_400.0) -> list[str]:
        """Delete data folders that none of the newest ``keep`` commits refers to, and the older commits' files.

        Only what is older than ``min_age`` seconds goes, which must be longer
        than any commit takes, as a folder has no commit yet while it is written.
        Returns the names of the folders removed.
        """
        numbers = self._numbers()
        kept = numbers[-max(keep, 1):]
        used = {f for n in kept for f in self.entry(n).folders.values()}
        before = (time.time() - min_age) * 1000

        def old(status) -> bool:
            return status.getModificationTime() <= before

        for n in numbers:
            file = self._path(self._file(n))
            if n not in kept and old(self._fs.getFileStatus(file)):
                self._fs.delete(file, False)
        gone = []
        data = self._path(f"{self.root}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = status.getPath().getName()
            if name not in used and old(status) and self._fs.delete(status.getPath(), True):
                gone.append(name)
        return sorted(gone)
