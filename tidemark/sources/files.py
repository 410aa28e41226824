"""Small file operations through Hadoop's FileSystem, so that a store may live wherever Spark reads."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidemark.errors import ConflictError, StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def mkdirs(self, name: str) -> None:
        if not self._fs.mkdirs(self._path(self.full(name))):
            raise StorageError(f"can't make {name}")

    def list(self, name: str) -> list[tuple[str, int, bool]]:
        """``(name, bytes, is_dir)``, sorted by name; empty when there is no such folder."""
        return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in self._status(name))

    def _status(self, name: str) -> list:
        path = self._path(self.full(name))
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def changed(self, name: str) -> float:
        """Seconds since 1970 when a file, or the newest file of a folder, was last written; 0 if there is none."""
        path = self._path(self.full(name))
        if not self._fs.exists(path):
            return 0.0
        own = self._fs.getFileStatus(path)
        inside = [s.getModificationTime() for s in self._status(name)] if own.isDirectory() else []
        return max([own.getModificationTime(), *inside]) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.full(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file that must not exist yet; readers see all of it or nothing, and of two writers one wins.

        Local files are linked to their name, elsewhere they are renamed: both fail if the name is taken. A store of
        objects without such a rename must have one writer.
        """
        target, staged = self._path(self.full(name)), self._path(self.full(f"{name}.{self._jvm.java.util.UUID.randomUUID()}.tmp"))
        stream = self._fs.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(target), local(staged))
            elif self._fs.exists(target) or not self._fs.rename(staged, target):
                raise ConflictError(f"{name} was published by another writer")
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise ConflictError(f"{name} was published by another writer") from e
        finally:
            self._fs.delete(staged, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.full(name)), True)
