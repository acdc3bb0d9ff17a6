"""Small files and folders of any file system that Spark reaches, by Hadoop's client on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file and renames over it: readers see the old or the new text."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(beside)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs_pkg = self._jvm.org.apache.hadoop.fs
        options = self._gateway.new_array(getattr(fs_pkg, "Options$Rename"), 1)
        options[0] = getattr(getattr(fs_pkg, "Options$Rename"), "OVERWRITE")
        where = fs.makeQualified(p)
        fs_pkg.FileContext.getFileContext(where.toUri(), self._conf).rename(fs.makeQualified(beside), where, options)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [f"{path.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(p)] if fs.exists(p) else []

    def sizes(self, path: str) -> dict[str, int]:
        """The bytes of each child folder, by its name."""
        fs, p = self._at(path)
        return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(p) if s.isDirectory()}
