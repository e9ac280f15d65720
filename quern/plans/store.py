"""Small JSON documents with versions, in any store that Spark reaches.

A document is a folder of numbered files.  A new version is written under a temporary name and renamed to its number, which
fails if that number is there: readers see whole versions only, and of two writers that start from the same version one is told.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """The document was changed since the version that a write is based on."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(), self._path(name)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(f[:-5]) for f in found if f.endswith(".json") and f[:-5].isdigit())

    def read(self, name: str, default: object = None) -> tuple[int, object]:
        """The current version's number and value; 0 and ``default`` if there is none."""
        versions = self._versions(name)
        if not versions:
            return 0, default
        fs, p = self._fs(), self._path(name, f"{versions[-1]:020d}.json")
        stream = fs.open(p)
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return versions[-1], json.loads(data)

    def write(self, name: str, value: object, base: int | None = None, keep: int = 20) -> int:
        """Writes the version after ``base`` (by default after the current one); the ``keep`` latest versions stay."""
        versions = self._versions(name)
        base = (versions[-1] if versions else 0) if base is None else base
        if versions and versions[-1] > base:
            raise Conflict(f"{name} is at version {versions[-1]}, not {base}")
        fs = self._fs()
        fs.mkdirs(self._path(name))
        temp, final = self._path(name, f".{uuid.uuid4().hex}"), self._path(name, f"{base + 1:020d}.json")
        out = fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
            kind = self._jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            context.rename(temp, final, options)
        except Exception as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e) or fs.exists(final):
                raise Conflict(f"{name} has a version {base + 1} already") from e
            raise
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            fs.delete(self._path(name, f"{old:020d}.json"), False)
        return base + 1

    def names(self) -> list[str]:
        fs, p = self._fs(), self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def delete(self, name: str) -> bool:
        return self._fs().delete(self._path(name), True)
