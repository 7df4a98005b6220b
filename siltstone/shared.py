"""Cutting lineage, and files in whatever store the cluster uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session makes a temporary folder once; a cluster is told to
    set it, because a folder of the driver's machine would not be shared.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Store:
    """A folder in any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.base, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.at(*parts)))

    def read(self, name: str) -> str | None:
        """The text of a small file, or None."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        """The names in the folder; none if it is not there."""
        base = self._path(self.base)
        return [f.getPath().getName() for f in self._fs.listStatus(base)] if self._fs.exists(base) else []

    def size(self, *parts: str) -> int:
        """Bytes of a folder and all below it."""
        return self._fs.getContentSummary(self._path(self.at(*parts))).getLength()

    def create(self, name: str, text: str) -> bool:
        """Write a small file, whole, unless there is one of that name already; whether it was written.

        Of several writers one succeeds, where renaming does not replace (HDFS) or on a local disk.
        """
        scratch = self._path(self.at(f".{uuid.uuid4().hex}.new"))
        stream = self._fs.create(scratch, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(self.at(name))
        if self._fs.getScheme() == "file":
            try:
                os.link(scratch.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(scratch, False)
        if self._fs.exists(target) or not self._fs.rename(scratch, target):
            self._fs.delete(scratch, False)
            return False
        return True

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.at(*parts)), True)
