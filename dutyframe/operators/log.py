"""A commit log: which folders make up a set of tables, version by version.

A version is one small file that names the folders of every table. It is written aside and then renamed to its
number, which fails if that number is taken; so a version is there as a whole or not at all, and of two writers
that began at one version the second one is refused. Folders that no version names are no part of any table: what a writer
left behind that broke off between two tables is never read. The folder must be on a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _file(self, version: int) -> str:
        return f"{self.root}/_log/{version:020d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last one without: version, tables (name: folders), writers (name: last batch and what it told)."""
        if version is None:
            there = self.versions()
            if not there:
                return {"version": 0, "tables": {}, "writers": {}}
            version = there[-1]
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """The manifest as its version; a Conflict if that one is there."""
        aside, final = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}"), self._path(self._file(manifest["version"]))
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, final, keep)
        except Exception as error:
            taken = self._fs.exists(final)
            self._fs.delete(aside, False)
            if taken and (isinstance(error, PySparkException) or "FileAlreadyExists" in str(error)):
                raise Conflict(f"version {manifest['version']} of {self.root} is taken") from None
            raise

    def folders(self, table: str) -> list[str]:
        """All folders of a table, those of no version too."""
        top = self._path(f"{self.root}/{table}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
