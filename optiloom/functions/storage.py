"""Cutting lineage into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch that removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_lock = threading.Lock()
_writes = 0
_before = "false"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The switch is on while any thread writes, and as it was once none does."""
    global _writes, _before
    with _lock:
        if not _writes:
            _before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writes += 1
    try:
        yield
    finally:
        with _lock:
            _writes -= 1
            if not _writes:
                spark.conf.set(_CLEANUP, _before)


class Scratch:
    """Parquet tables in a folder of their own below the shared one.

    A table's shuffle files go when it is written; the tables go with :meth:`drop`,
    for which every result that still reads them has to be written first, or else
    when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path()
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read from there."""
        path = f"{self.folder}/{self._n}"
        self._n += 1
        with _cleaning(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def drop(self) -> None:
        path = self._path()
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there: smaller than a checkpoint."""
    return Scratch(df.sparkSession).save(df)
