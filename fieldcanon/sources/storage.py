"""Storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the run at hand, see ``run_folder``.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)
#: The temporary folder of a local session that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session, as in tests, gets a
    temporary folder of its own where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="fieldcanon-")
    return _LOCAL[app]


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder, or in the folder of the run, that nothing else uses."""
    return f"{_RUN.get() or shared_dir(spark) + '/fieldcanon'}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, wherever Spark can write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables that are written inside the ``with`` block, deleted at its end.

    Results that read from them must have been saved elsewhere by then. Outside such a block the
    tables stay in the shared folder, for results may still read them.
    """
    folder = new_folder(spark)
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        discard(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, unlike a cached table; and Spark
    knows the table's size when it plans what follows.
    """
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
