"""Small files and folders through Hadoop's FileSystem, so that a store may lie wherever Spark can read and write."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(self.conf)
        return system, system.makeQualified(place)

    def is_folder(self, path: str) -> bool:
        system, place = self._at(path)
        return system.exists(place) and system.getFileStatus(place).isDirectory()

    def read(self, path: str) -> str | None:
        """The text of a file; None if there is none."""
        system, place = self._at(path)
        if not system.exists(place):
            return None
        stream = system.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        system, place = self._at(path)
        stream = system.create(place, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Readers see the text before or the text now, never a part."""
        pending = f"{path}.pending"
        self._put(pending, text)
        (_, source), (_, target) = self._at(pending), self._at(path)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, how)

    def create(self, path: str, text: str) -> bool:
        """Makes the file unless it is there: of several that try, one succeeds."""
        system, place = self._at(path)
        system.mkdirs(place.getParent())
        if place.toUri().getScheme() == "file":  # Hadoop looks first and creates then on local disks
            try:
                at = os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(at, "w") as f:
                f.write(text)
            return True
        if system.exists(place):
            return False
        try:
            stream = system.create(place, False)
        except Exception:
            if system.exists(place):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)
