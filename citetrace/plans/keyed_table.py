"""A stored table with keyed upserts: copy on write of the files that hold a key of the batch, and of no others.

A version is a list of Parquet files. An index beside them has the range of keys of each file and a Bloom filter of its keys, as bitmaps of 4 KB. A batch is
held against ranges, then filters, then the keys of the files that are left, so the files to write again are exactly those that hold one of its keys; new keys go
into files of their own or along with those. A version is in place when its manifest is, and older ones can be read until they are dropped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetrace.operators.ordered import running
from citetrace.plans.manifests import Manifests
from citetrace.plans.storage import materialise

#: Rows of a file; bits of a filter for each row of its file, and bits that a key sets.
FILE_ROWS, KEY_BITS, PROBES = 1_000_000, 12, 5
_BITMAP = 32768
#: Files up to which each key is compared with the range of each; of more, the file is found by a place in order.
FEW_FILES = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], file_rows: int = FILE_ROWS):
        self.spark, self.folder, self.schema, self.key, self.file_rows = spark, folder.rstrip("/"), schema, list(key), file_rows
        self._manifests = Manifests(spark, folder)

    # --- reading ---

    def versions(self) -> list[int]:
        return self._manifests.numbers()

    def said(self, version: int | None = None) -> dict:
        """The manifest: files (path, rows, bytes, index), and what the version's batch did: rows in, files written again and left alone, bytes."""
        return self._manifests.load(version) or {"number": 0, "files": [], "batch": -1}

    def read(self, version: int | None = None) -> DataFrame:
        return self._open([f["path"] for f in self.said(version)["files"]])

    def _open(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    # --- writing ---

    def upsert(self, batch: DataFrame, order: Sequence[str] = (), number: int | None = None) -> dict:
        """Put the rows of a batch in place of those of the same key, nulls too; of equal keys in the batch the last by ``order`` counts. Rows with a null in the key are an error.

        A batch whose ``number`` is not above the last taken changes nothing.
        """
        own = materialise(batch.select(*self._columns(), *[c for c in order if c not in self._columns()]), "upsert-batch")
        if not own.where(" or ".join(f"{c} is null" for c in self.key)).isEmpty():
            raise ValueError(f"a key of {self.folder} is null")
        if order:
            last = Window.partitionBy(*self.key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
            own = own.withColumn("_r", F.row_number().over(last)).where("_r = 1")
        return self._change(own.select(*self._columns()), own.select(*self.key), number)

    def delete(self, keys: DataFrame, number: int | None = None) -> dict:
        """Take out the rows of the keys."""
        return self._change(None, keys.select(*self.key).distinct(), number)

    def _columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).names

    def _change(self, rows: DataFrame | None, keys: DataFrame, number: int | None) -> dict:
        before = self.said()
        if number is not None and number <= before["batch"]:
            return before
        touched = self._holding(before["files"], keys)
        stay = [f for f in before["files"] if f["path"] not in touched]
        kept = self._open(sorted(touched)).join(keys, self.key, "left_anti").select(*self._columns())
        if rows is None and not touched:
            made = []
        else:
            made = self._write(kept if rows is None else kept.unionByName(rows))
        after = {
            "number": before["number"] + 1, "files": stay + made, "batch": before["batch"] if number is None else number,
            "rewritten": len(touched), "left_alone": len(stay), "written_bytes": sum(f["bytes"] for f in made), "written_rows": sum(f["rows"] for f in made),
        }
        self._publish(after)
        return after

    def _publish(self, said: dict) -> None:
        self._manifests.publish(said["number"], said)

    def _write(self, rows: DataFrame) -> list[dict]:
        """Write rows in files of a range of keys each, with their index."""
        rows = materialise(rows, "upsert-rows")
        name = uuid.uuid4().hex
        parts = max(1, math.ceil(rows.count() / self.file_rows))
        rows.repartitionByRange(parts, *self.key).sortWithinPartitions(*self.key).write.parquet(f"{self.folder}/files/{name}")
        found = dict(self._manifests.found(f"files/{name}/*.parquet"))
        keyed = self._keyed([f"files/{name}"])
        per_file = keyed.groupBy("_file").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count("*").alias("_rows"))
        size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(_BITMAP), F.col("_rows") * KEY_BITS)))).cast("long")
        per_file = materialise(per_file.withColumn("_size", size), "file-ranges")
        per_file.write.parquet(f"{self.folder}/index/{name}/ranges")
        marked = keyed.join(F.broadcast(per_file.select("_file", "_size")), "_file").select("_file", F.explode(self._positions()).alias("_at"))  # one row a file of this batch
        marked = marked.groupBy("_file", F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bitmap"))
        marked.write.parquet(f"{self.folder}/index/{name}/filters")
        return [{"path": r._file, "rows": r._rows, "bytes": found[r._file], "index": name} for r in per_file.select("_file", "_rows").collect()]  # one row a file of this batch

    def _keyed(self, paths: list[str]) -> DataFrame:
        """(_file, _key) of the rows of files."""
        path = F.regexp_extract("_metadata.file_path", r"(files/[0-9a-f]+/[^/]+)$", 1)
        return self._open(paths).select(path.alias("_file"), F.struct(*self.key).alias("_key"))

    def _positions(self) -> Column:
        """The bits that ``_key`` sets in a filter of ``_size`` bits, numbered from 1."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), "_key"), "_size") + 1 for i in range(PROBES)])

    def _holding(self, files: list[dict], keys: DataFrame) -> set[str]:
        """The files that hold one of the keys."""
        if not files:
            return set()
        live = self.spark.createDataFrame([(f["path"],) for f in files], "_file string")
        indexes = sorted({f["index"] for f in files})
        part = lambda kind: self.spark.read.parquet(*[f"{self.folder}/index/{i}/{kind}" for i in indexes]).join(F.broadcast(live), "_file", "left_semi")
        asked = keys.select(F.struct(*self.key).alias("_key"))
        near = self._near(part("ranges").withColumn("_index", F.split_part("_file", F.lit("/"), F.lit(2))), indexes, asked, len(files))
        probes = near.select("_file", "_key", F.explode(self._positions()).alias("_at")).withColumn("_bucket", F.bitmap_bucket_number("_at"))
        bit = F.bitmap_bit_position("_at")
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = probes.join(part("filters"), ["_file", "_bucket"]).where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
        maybe = materialise(hit.groupBy("_file", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") == PROBES).select("_file", "_key"), "upsert-candidates")
        candidates = [r._file for r in maybe.select("_file").distinct().collect()]  # at most one a file
        if not candidates:
            return set()
        there = self._keyed(candidates).join(maybe, ["_file", "_key"], "left_semi")
        return {r._file for r in there.select("_file").distinct().collect()}

    def _near(self, ranges: DataFrame, indexes: list[str], asked: DataFrame, files: int) -> DataFrame:
        """(_file, _key, _size): the keys with the files in whose range they are. Files of one write have ranges apart, so of each write it can only be the last that begins at or before the key."""
        if files <= FEW_FILES:
            return asked.join(F.broadcast(ranges), F.col("_key").between(F.col("_low"), F.col("_high"))).select("_file", "_key", "_size")  # one row a file, no row of the table
        number = F.row_number().over(Window.partitionBy("_index").orderBy("_low")).alias("_place")  # one row a file
        ranges, asked, out = materialise(ranges.select("_index", "_file", "_low", "_high", "_size", number), "near-ranges"), materialise(asked, "asked-keys"), None
        for index in indexes:
            own = ranges.where(F.col("_index") == index)
            both = asked.withColumn("_asks", F.lit(1)).unionByName(own.select(F.col("_low").alias("_key"), F.lit(0).alias("_asks")))
            placed = running(both, [F.col("_key"), F.col("_asks")], 1 - F.col("_asks"), "_place").where("_asks = 1")
            near = placed.join(F.broadcast(own), "_place").where(F.col("_key") <= F.col("_high")).select("_file", "_key", "_size")
            out = near if out is None else out.unionByName(near)
        return out

    def drop_versions(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``, and the files that only they have."""
        gone, stay = self.versions()[:-keep], self.versions()[-keep:]
        paths = lambda n: {f["path"] for f in self.said(n)["files"]}
        indexes = lambda n: {f["index"] for f in self.said(n)["files"]}
        needed, names = set().union(*map(paths, stay)), set().union(*map(indexes, stay))
        for n in gone:
            for path in paths(n) - needed:
                self._manifests.delete(path)
            for name in indexes(n) - names:
                self._manifests.delete(f"index/{name}")
                self._manifests.delete(f"files/{name}")
            self._manifests.drop(n)
