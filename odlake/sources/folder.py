"""Small files of a folder on any file system that Spark reads, by name: listed, read, written once and removed by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self._path, self._io = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What is directly below, sorted; nothing, if it does not exist."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def changed(self, name: str) -> float:
        """Seconds since the epoch at which it was last changed."""
        return self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """A new file, there whole or not at all; False if the name is taken."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(part), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self._fs.rename(self._at(part), self._at(name)):
            self.remove(part)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
