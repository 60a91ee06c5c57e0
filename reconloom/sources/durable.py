"""Written intermediates that any executor can read back after another is lost.

Lineage is cut by writing a Parquet table below the folder that the cluster
names in ``spark.checkpoint.dir``. A machine-local folder is used only where
that setting is empty and the master is local (tests on one machine).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from reconloom.sources.shipping import ship

#: The open blocks of this thread or task of asyncio, the innermost last: others' tables are not theirs to delete.
_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch blocks", default=())


class Scratch:
    """The tables written inside a ``scratch`` block."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str = "result") -> DataFrame:
        """Write ``df`` now, as the table that outlives the block."""
        out = durable(df, label)
        self.made = [x for x in self.made if x is not out]
        if len(_scopes.get()) > 1:
            _scopes.get()[-2].made.append(out)
        return out


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables that ``durable`` writes inside the block are deleted at its end, those that ``keep`` returns excepted.

    Blocks nest: what an inner one keeps is deleted with the outer one."""
    scope = Scratch()
    token = _scopes.set((*_scopes.get(), scope))
    try:
        yield scope
    finally:
        _scopes.reset(token)
        release(*scope.made)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/reconloom-checkpoints"
    return found.rstrip("/")


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, files = _location(spark, path)
    files.deleteOnExit(target)  # what nobody releases goes with the application
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    if _scopes.get():
        _scopes.get()[-1].made.append(out)
    return out


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for files of other kinds; it goes with the application unless ``remove`` deletes it."""
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target, files = _location(spark, path)
    files.deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it."""
    target, files = _location(spark, path)
    files.delete(target, True)


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``durable`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_durable_path", None)
        if path:
            remove(df.sparkSession, path)


def _location(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
