"""Dumps of citation indexes: zipped CSV archives as a data source, a partition for each member, and the rows of wanted ids only.

A member is inflated as a stream and parsed block by block into Arrow batches, so neither an archive nor a member is ever held whole. Only the columns of the
given schema are parsed, filters that Spark pushes are applied to each block before it leaves the task, and so is a Bloom filter of wanted ids, which is made of
bitmaps by Spark and has a fixed number of bits. A join with the ids themselves follows, so the filter decides nothing.
"""

from __future__ import annotations

import base64
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession, datasource
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that are parsed at once.
BLOCK_BYTES = 1 << 20
#: Bits of a filter of wanted ids (at most; 1 MB) and bits that an id sets. Beyond a tenth of the bits as ids the filter lets much through, never too little.
FILTER_BITS, PROBES = 1 << 23, 4
_BITMAP = 32768
#: The seed of Spark's xxhash64.
_SEED = 42


@dataclass
class Member(datasource.InputPartition):
    archive: str
    name: str


@dataclass
class Written(datasource.WriterCommitMessage):
    path: str | None


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(path: str) -> list[str]:
    system, at = _files(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".zip"))


class ZippedCsv(datasource.DataSource):
    """``spark.read.format("zipped_csv").schema(…).load(folder or archive)``: the CSV members, each with a header, of all archives. ``write`` makes an archive a task.

    Columns are found by name; one that a member lacks is null there. Without a schema all columns of the first member are read, as text. Quoted cells may
    hold line ends; an empty cell is null. Options: ``filter_column`` and ``filter`` (see ``wanted_filter``); for writing ``member_rows``.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> T.StructType:
        archives = _archives(self.options["path"])
        for archive in archives:
            with _files(self.options["path"])[0].open_input_file(archive) as file, zipfile.ZipFile(file) as z:
                for name in z.namelist():
                    if name.endswith(".csv"):
                        with z.open(name) as raw:
                            head = raw.readline().rstrip()
                        if head:
                            return T.StructType([T.StructField(c, T.StringType()) for c in csv.open_csv(io.BytesIO(head + b"\n")).schema.names])
        raise ValueError(f"no CSV member in {self.options['path']}")

    def reader(self, schema: T.StructType) -> ZippedCsvReader:
        return ZippedCsvReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ZippedCsvWriter:
        return ZippedCsvWriter(schema, self.options)


class ZippedCsvReader(datasource.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options, self.tests = schema, options, []

    def pushFilters(self, filters: list[datasource.Filter]) -> Iterator[datasource.Filter]:
        for f in filters:
            known = isinstance(f, (datasource.EqualTo, datasource.In, datasource.IsNotNull, datasource.StringStartsWith)) and len(f.attribute) == 1
            if known:
                self.tests.append((type(f).__name__, f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Member]:
        system, out = _files(self.options["path"])[0], []
        for archive in _archives(self.options["path"]):
            with system.open_input_file(archive) as file, zipfile.ZipFile(file) as z:  # its directory alone is read
                out += [Member(archive, name) for name in z.namelist() if name.endswith(".csv")]
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if not partition.archive:
            return
        want = _Filter(self.options["filter"]) if self.options.get("filter") else None
        with _files(self.options["path"])[0].open_input_file(partition.archive) as file, zipfile.ZipFile(file) as z, z.open(partition.name) as raw:
            head = raw.readline()
            if not head.strip():
                return  # an empty member
            have = csv.open_csv(io.BytesIO(head.rstrip() + b"\n")).schema.names
            raw.seek(0)
            convert = csv.ConvertOptions(
                include_columns=[n for n in schema.names if n in have], column_types={f.name: f.type for f in schema}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True
            )
            if not convert.include_columns:
                convert.include_columns = have[:1]  # for the number of rows
            blocks = csv.open_csv(raw, csv.ReadOptions(block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True), convert)
            for b in blocks:
                columns = [b.column(n) if n in b.schema.names else pa.nulls(b.num_rows, schema.field(n).type) for n in schema.names]
                b = pa.RecordBatch.from_arrays(columns, schema=schema)
                for kind, name, value in self.tests:
                    b = b.filter(pc.fill_null(_holds(kind, b.column(name), value), False))
                if want is not None and b.num_rows:
                    b = b.filter(want.may_hold(b.column(self.options["filter_column"])))
                if b.num_rows:
                    yield b


def _holds(kind: str, x: pa.Array, value) -> pa.Array:
    if kind == "IsNotNull":
        return x.is_valid()
    if kind == "StringStartsWith":
        return pc.starts_with(x, value)
    values = [value] if kind == "EqualTo" else list(value)
    return pc.is_in(x, value_set=pa.array(values, type=x.type), skip_nulls=True)


class ZippedCsvWriter(datasource.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One archive a task, under a name of its own; members of ``member_rows`` rows or a little more."""
        from pyspark import TaskContext

        context, most = TaskContext.get(), int(self.options.get("member_rows", 1_000_000))
        system, at = _files(self.options["path"])
        system.create_dir(at, recursive=True)
        path = f"{at}/part-{context.partitionId():05d}-{context.taskAttemptId()}.zip"
        members = rows = 0
        out = None
        with system.open_output_stream(f"{path}.draft") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for b in iterator:
                if out is None:
                    raw = z.open(f"{members:05d}.csv", "w", force_zip64=True)
                    out, members, rows = csv.CSVWriter(raw, b.schema), members + 1, 0
                out.write(b)
                rows += b.num_rows
                if rows >= most:
                    out.close(), raw.close()
                    out = None
            if out is not None:
                out.close(), raw.close()
        return Written(path if members else None)

    def commit(self, messages: list[Written]) -> None:
        """Archives get their names once all tasks are done; what attempts left without that is never read."""
        system, at = _files(self.options["path"])
        for m in messages:
            if m is not None and m.path:
                system.move(f"{m.path}.draft", m.path)

    def abort(self, messages: list[Written]) -> None:
        pass


class _Filter:
    """The bits of ``wanted_filter``, asked for columns of text."""

    def __init__(self, packed: str):
        self.bits = np.frombuffer(zlib.decompress(base64.b64decode(packed)), dtype=np.uint8)

    def may_hold(self, x: pa.Array) -> pa.Array:
        size = len(self.bits) * 8
        hashes = np.array([0 if v is None else xxhash.xxh64_intdigest(v, seed=_SEED) for v in x.cast(pa.binary()).to_pylist()], dtype=np.uint64)
        low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.int64) | 1
        ok = np.ones(len(hashes), dtype=bool)
        for i in range(PROBES):
            at = (low + i * high) % size
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pa.array(ok & ~np.array(x.is_null()))


def wanted_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> str:
    """A Bloom filter of a column of text, for the option ``filter``: bitmaps made map-side, of at most ``bits`` bits in all, whatever the number of ids."""
    h = F.xxhash64(column)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + i * high) % bits + 1 for i in range(PROBES)])).alias("at")
    maps = ids.where(F.col(column).isNotNull()).select(at).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, m in maps.collect():  # at most bits / 32768 rows of 4 KB
        out[(b - 1) * _BITMAP // 8 : b * _BITMAP // 8] = np.frombuffer(bytes(m), dtype=np.uint8)
    return base64.b64encode(zlib.compress(out.tobytes())).decode()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedCsv)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, schema: str | None = None, wanted: DataFrame | None = None, column: str | None = None) -> DataFrame:
    """Rows of the archives below a path; with ``wanted`` (a frame that has ``column``), those whose column is one of its values."""
    register(spark)
    source = spark.read.format("zipped_csv")
    source = source.schema(schema) if schema else source
    if wanted is None:
        return source.load(path)
    ids = wanted.select(column).distinct()
    near = source.option("filter_column", column).option("filter", wanted_filter(ids, column)).load(path)
    return near.join(ids, column, "left_semi")


def write(rows: DataFrame, path: str, member_rows: int = 1_000_000) -> None:
    register(rows.sparkSession)
    rows.write.format("zipped_csv").option("member_rows", member_rows).mode("append").save(path)
