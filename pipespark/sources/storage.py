"""Files of any store that Spark reaches, through its Hadoop file systems: local, HDFS, object stores."""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import SparkSession

from ..errors import SourceError


@dataclasses.dataclass(frozen=True)
class Storage:
    spark: SparkSession

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        try:
            return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p
        except Exception as e:
            raise SourceError(f"no file system for '{path}'", hints=["use file://, hdfs://, s3a://, gs:// or abfss://, with its connector on the class path"]) from e

    def _status(self, path: str):
        fs, p = self._at(path)
        if not fs.exists(p):
            raise SourceError(f"'{path}' does not exist")
        return fs.getFileStatus(p)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def write(self, path: str, data: bytes) -> None:
        """Creates the file, with its folders, or replaces it."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data), 0, len(data))
        finally:
            out.close()

    def read_range(self, path: str, start: int, length: int) -> bytes:
        """At most ``length`` bytes from ``start``; fewer at the end of the file."""
        size = self._status(path).getLen()
        length = max(0, min(length, size - start))
        if start < 0 or not length:
            return b""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            stream.seek(start)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.readFully(stream, length))
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        """Whether there was something to delete; folders go with their contents."""
        fs, p = self._at(path)
        return fs.delete(p, True)

    def list(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, path: str) -> list:
        """The status of each file that a path stands for: a file, a folder's files at any depth (but hidden ones), or those that a pattern matches."""
        fs, p = self._at(path)
        found, out = list(fs.globStatus(p) or ()), []
        if not found:
            raise SourceError(f"'{path}' does not exist")
        while found:
            s = found.pop()
            if s.isDirectory():
                found += [x for x in fs.listStatus(s.getPath()) if x.getPath().getName()[0] not in "._"]
            else:
                out.append(s)
        return out

    def size(self, path: str) -> int:
        return self._status(path).getLen()

    def etag(self, path: str) -> str:
        """Changes when the place, length or time of change of a file that the path stands for does; the contents aren't read."""
        marks = sorted(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}" for s in self.files(path))
        return hashlib.sha256("\n".join(marks).encode()).hexdigest()
