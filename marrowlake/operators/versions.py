"""Numbered versions of a stored thing: a folder of manifests, of which the newest counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """JSON manifests <n>.json below a shared folder.

    A manifest is written aside and renamed to a number that must be free, so a reader sees the old or the new version and never a part, and of two writers one
    fails. The file system must rename atomically and refuse to replace (HDFS and local disks do); on an object store only one writer may be at work.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> dict | None:
        """The manifest of a number, the newest without one; None if there is none."""
        if number is None:
            known = self.numbers()
            if not known:
                return None
            number = known[-1]
        stream = self._fs.open(self._path(f"{self.path}/{number:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Makes manifest["version"] the newest; raises if that number is taken."""
        self._fs.mkdirs(self._path(self.path))
        final = self._path(f"{self.path}/{manifest['version']:010d}.json")
        aside = self._path(f"{self.path}/{manifest['version']:010d}-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer published version {manifest['version']}")

    def drop(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.path}/{number:010d}.json"), False)

    def remove(self, folder: str) -> None:
        """Deletes a folder that no manifest names."""
        self._fs.delete(self._path(folder), True)
