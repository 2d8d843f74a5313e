"""Tables whose changes are committed one after the other, whole or not at all.

A table is a folder of data folders, which never change, and a log of numbered entries, each put there
only if no other writer has put that number. An entry adds a data folder to the table or replaces all
before it. So a failed write leaves the table as it was; readers keep the version that they began with;
of two writers that start from the same version one has to look again; and a batch that is in the log
isn't written a second time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard, exists

ENTRY = "version bigint, kind string, folder string, batch string, note string"


class Conflict(Exception):
    """Another writer was first."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole under its name, unless there is one. It is written under
    another name first; giving it its own is one step that fails where the name is taken."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), none)
    except Exception as e:  # the gateway wraps what Java throws
        files.delete(draft, False)
        if "FileAlreadyExists" in f"{e!r} {e}":
            return False
        raise
    return True


@dataclass(frozen=True)
class Entry:
    version: int
    kind: str
    folder: str
    batch: str | None
    note: str | None


@dataclass(frozen=True)
class CommittedTable:
    """A table at a path that all of the cluster shares."""

    spark: SparkSession
    path: str
    schema: str

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def log(self) -> DataFrame:
        """All entries: ``version, kind, folder, batch, note``."""
        if not exists(self.spark, self._log):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(self._log)

    def version(self) -> int:
        """The number of the last entry, 0 for a table without any."""
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _parts(self, version: int | None, since: int = 0) -> list[Entry]:
        """The entries that make up a version, from the last that replaces all before: as many as were added
        since the table was last rewritten."""
        log = self.log().where(F.col("version") > since)
        if version is not None:
            log = log.where(F.col("version") <= version)
        last = log.where("kind = 'replace'").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        return [Entry(**r.asDict()) for r in log.where(F.col("version") >= last).orderBy("version").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last one if none is named. Later commits don't change them."""
        return self._rows(self._parts(version))

    def since(self, version: int, until: int | None = None) -> DataFrame:
        """The rows that were added after a version."""
        parts = self._parts(until, version)
        if any(e.kind == "replace" for e in parts):
            raise ValueError(f"the table was rewritten after version {version}")
        return self._rows(parts)

    def _rows(self, parts: list[Entry]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{e.folder}" for e in parts))

    def has(self, batch: str) -> bool:
        return not self.log().where(F.col("batch") == batch).isEmpty()

    def commit(self, rows: DataFrame, expected: int, kind: str = "append", batch: str | None = None, note: str | None = None) -> int:
        """Write ``rows`` and make them the version after ``expected``. Raises ``Conflict``, and leaves nothing
        behind, where that version is there by now."""
        folder = f"data/{uuid.uuid4().hex}"
        try:
            rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/{folder}")
            entry = {"version": expected + 1, "kind": kind, "folder": folder, "batch": batch, "note": note}
            if not put_if_absent(self.spark, f"{self._log}/{expected + 1:012d}.json", json.dumps(entry)):
                raise Conflict(f"version {expected + 1} of {self.path} is there already")
        except (Conflict, PySparkException):
            discard(self.spark, f"{self.path}/{folder}")
            raise
        return expected + 1

    def change(self, make: Callable[[DataFrame], DataFrame], kind: str = "append", batch: str | None = None, attempts: int = 10) -> int:
        """Commit what ``make`` gives for the table's rows: rows to add, or with ``replace`` all rows.

        Where another writer was first, ``make`` is asked again with the rows as they are then. A batch
        that is in the log is left alone; returned is the table's version.
        """
        for _ in range(attempts):
            at = self.version()
            if batch is not None and self.has(batch):
                return at
            try:
                return self.commit(make(self.read(at)), at, kind, batch)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: other writers were first {attempts} times")

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        return self.change(lambda _: rows, "append", batch)

    def replace(self, rows: DataFrame, batch: str | None = None) -> int:
        return self.change(lambda _: rows, "replace", batch)

    def compact(self) -> int:
        """Rewrite the table as one data folder; older versions can still be read."""
        return self.change(lambda rows: rows, "replace")

    def vacuum(self, keep: int = 1) -> int:
        """Delete data folders that none of the last ``keep`` versions reads; how many. Nobody may be writing or
        reading older versions meanwhile."""
        last = self.version()
        used = {e.folder for v in range(max(1, last - keep + 1), last + 1) for e in self._parts(v)}
        gone = [r["folder"] for r in self.log().select("folder").collect() if r["folder"] not in used]
        gone = [f for f in gone if exists(self.spark, f"{self.path}/{f}")]
        for folder in gone:
            discard(self.spark, f"{self.path}/{folder}")
        return len(gone)
