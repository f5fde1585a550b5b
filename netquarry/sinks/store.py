"""Small files and folders on whatever file system Spark reads: state that outlives a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """One folder, by paths relative to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._types = spark._jvm.org.apache.hadoop.fs
        self._files = self._types.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._types.Path(self.folder))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _at(self, name: str):
        return self._types.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What is in a folder; nothing, if it isn't there."""
        at = self._at(name) if name else self._types.Path(self.folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, whole or not at all; False if another was there first."""
        own = self._at(f".{name}.part")
        stream = self._files.create(own, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self._files.rename(own, self._at(name)):
            self._files.delete(own, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)

    def size(self) -> int:
        """Bytes of all files."""
        return self._files.getContentSummary(self._types.Path(self.folder)).getLength()
