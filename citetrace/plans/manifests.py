"""Numbered manifests in a shared folder: what is current is what the newest one says, and putting one in place is the only change that readers see."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}" if path else self.folder)

    def numbers(self) -> list[int]:
        found = self._fs.globStatus(self._at("manifest/*.json")) or []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def load(self, number: int | None = None) -> dict | None:
        """The newest manifest, or the one of a number; none in an empty folder."""
        numbers = self.numbers()
        if not numbers:
            return None
        at = self._fs.open(self._at(f"manifest/{numbers[-1] if number is None else number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8"))
        finally:
            at.close()

    def publish(self, number: int, said: dict) -> None:
        """Put a manifest in place by a rename; that another writer has taken its number is an error."""
        final, draft = self._at(f"manifest/{number:012d}.json"), self._at(f"drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has put manifest {number} of {self.folder} in place")

    def drop(self, number: int) -> None:
        self._fs.delete(self._at(f"manifest/{number:012d}.json"), False)

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def found(self, pattern: str) -> list[tuple[str, int]]:
        """(path below the folder, bytes) of what matches."""
        return [(s.getPath().toUri().getPath().removeprefix(self._at("").toUri().getPath() + "/"), s.getLen()) for s in self._fs.globStatus(self._at(pattern)) or []]

    def length(self, path: str) -> int:
        return self._fs.getContentSummary(self._at(path)).getLength()
