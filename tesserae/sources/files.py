"""Small files on whatever file system Spark sees: the manifest and folders of parts."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    """Access through Hadoop's FileSystem, so local, HDFS and object-store paths are alike."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def age(self, path: str) -> float:
        """Seconds since the file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Writes beside and renames into place; False if `path` is there already (another writer was first)."""
        if self.exists(path):
            return False
        beside = self._path(path + f".{self._jvm.java.util.UUID.randomUUID()}.tmp")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        moved = self.fs.rename(beside, self._path(path))
        if not moved:
            self.fs.delete(beside, False)
        return moved
