"""Folders whose content is replaced as a whole.

A new version is written beside the old one, and one small file, put in place by
a rename, says which version counts. Readers see the old content until then and
the new one after; a run that fails leaves the old one as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"


class Folder:
    """A folder of versions; the last two are kept, as readers may still be at the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[str]:
        """Names of the published versions that are kept, the current one last; empty if there is none."""
        if not self._files.exists(self._at(POINTER)):
            return []
        stream = self._files.open(self._at(POINTER))
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split()
        finally:
            stream.close()

    def current(self) -> str | None:
        """Path of the version that counts."""
        names = self.versions()
        return f"{self.path}/{names[-1]}" if names else None

    def replace(self, write: Callable[[str], None]) -> str:
        """Call ``write`` with the path of a new version and make that the current one."""
        name, before = f"v-{uuid.uuid4().hex}", self.versions()
        try:
            write(f"{self.path}/{name}")
            self._point([*before[-1:], name])
        except BaseException:
            self._files.delete(self._at(name), True)
            raise
        for old in before[:-1]:
            self._files.delete(self._at(old), True)
        return f"{self.path}/{name}"

    def _point(self, names: list[str]) -> None:
        beside = self._at(f"{POINTER}-{uuid.uuid4().hex}")
        stream = self._files.create(beside)
        stream.write(bytearray("\n".join(names), "utf-8"))
        stream.close()
        context = self._hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.spark._jvm.java.lang.reflect.Array.newInstance(options, 1)
        how[0] = next(o for o in options.getEnumConstants() if str(o) == "OVERWRITE")
        context.rename(self._files.makeQualified(beside), self._files.makeQualified(self._at(POINTER)), how)
