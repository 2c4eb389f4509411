"""A few file operations of the session's file systems (local, HDFS, object stores), through Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def matches(self) -> list[str]:
        """Paths that a glob stands for."""
        found = self.fs.globStatus(self.path)
        return [] if found is None else [f.getPath().toString() for f in found]

    def child(self, name: str) -> str:
        return self._path(self.path, name).toString()

    def modified_ms(self) -> int:
        return self.fs.getFileStatus(self.path).getModificationTime()

    def delete(self) -> bool:
        return self.fs.delete(self.path, True)

    def make_folder(self) -> bool:
        return self.fs.mkdirs(self.path)

    def touch(self) -> None:
        """Makes an empty file."""
        self.fs.create(self.path, True).close()

    def copy_to_local(self, to: str) -> None:
        self.fs.copyToLocalFile(False, self.path, self._path(to), True)

    def rename(self, to: str) -> bool:
        return self.fs.rename(self.path, self._path(to))

    def data_files(self) -> list[str]:
        """The files under the paths that a glob stands for, without those that begin with a dot or an underscore."""
        out = []
        for p in self.matches():
            status = self.fs.getFileStatus(self._path(p))
            files = [s.getPath() for s in self.fs.listStatus(self._path(p)) if s.isFile()] if status.isDirectory() else [self._path(p)]
            out += [f.toString() for f in files if f.getName()[0] not in "._"]
        return sorted(out)
