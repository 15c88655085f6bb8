"""Keyed tables that grow by runs: each batch adds sorted runs, readers merge them, and like-sized runs are compacted.

A store holds some tables below one folder. A row of a table has a key and an order; of equal keys the row that is least by the order counts. A batch writes
its own rows only, as one run for each bucket of the key's hash that it touches. Runs of a bucket are merged when ``FAN`` of a size tier have gathered, so a
row is written again once a tier; a table whose buckets grow beyond ``BUCKET_ROWS`` takes one more bit of the hash, and its runs are then split, once for each
doubling. A store that is mostly read whole may have large batches take in what is there (``absorb``). Writes go by slices of the buckets, so that what is shuffled at
a time has a bound. What is current is said by numbered manifests alone: a batch of all tables is one manifest, put in place by a rename, so readers see
all of it or nothing, and what an attempt has left without one is never read.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetrace.operators.sieve import among
from citetrace.plans.manifests import Manifests
from citetrace.plans.storage import put

#: Runs of one tier in a bucket that are merged, rows of the first tier, and rows of a bucket from which on the table takes one more bit.
FAN, TIER_ROWS, BUCKET_ROWS = 4, 1_000, 1_000_000
#: Rows that are shuffled at a time. A slice reads all rows that are to be written, so it is large.
SLICE_ROWS = 100_000_000
#: Manifests that stay for readers that began with them.
KEEP = 2


@dataclass(frozen=True)
class Table:
    """Columns of a table, its key, and the order by which the first row of a key counts (``-c`` for falling)."""

    schema: str
    key: tuple[str, ...]
    order: tuple[str, ...]

    def least(self, rows: DataFrame, *within: str) -> DataFrame:
        """The row of each key that counts; within: columns that follow from the key, by which the rows may be dealt already."""
        by = [F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c) for c in self.order]
        rest = [c for c in rows.columns if c not in {*within, *self.key, *(o.removeprefix("-") for o in self.order)}]  # rows of equal order: the first by the other columns
        first = F.row_number().over(Window.partitionBy(*within, *self.key).orderBy(*by, *rest))
        return rows.withColumn("_first", first).where("_first = 1").select(*rows.columns)


@dataclass
class State:
    """What a manifest says: its number, the runs and bits of each table, what has been written, and what batches leave as notes."""

    number: int = 0
    runs: dict[str, list[dict]] = field(default_factory=dict)
    bits: dict[str, int] = field(default_factory=dict)
    batch: int = -1
    written: int = 0
    rewritten: int = 0
    note: dict = field(default_factory=dict)


class LogStore:
    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, Table], bucket_rows: int = BUCKET_ROWS, tier_rows: int = TIER_ROWS, fan: int = FAN, slice_rows: int = SLICE_ROWS, absorb: int = 0):
        """absorb: a batch is merged with all of a table as it is written, if that holds at most so many times its rows. So each row brought has at most so many written again."""
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), dict(tables)
        self.bucket_rows, self.tier_rows, self.fan, self.slice_rows, self.absorb = bucket_rows, tier_rows, fan, slice_rows, absorb
        self._manifests = Manifests(spark, folder)

    def states(self) -> list[int]:
        """The numbers of the states that are still there."""
        return self._manifests.numbers()

    def state(self, number: int | None = None) -> State:
        """The newest state, or that of a number."""
        return State(**(self._manifests.load(number) or {}))

    def _publish(self, state: State) -> None:
        self._manifests.publish(state.number, vars(state))

    def _forget(self) -> None:
        """Delete old manifests and the runs that only they name."""
        gone, stay = self.states()[:-KEEP], self.states()[-KEEP:]
        paths = lambda n: {r["path"] for runs in self.state(n).runs.values() for r in runs}
        needed = set().union(*(paths(n) for n in stay))
        for n in gone:
            for path in paths(n) - needed:
                self._manifests.delete(path)
            self._manifests.drop(n)

    # --- reading ---

    def read(self, name: str, state: State | None = None, having: DataFrame | None = None) -> DataFrame:
        """The rows that count. Buckets of one run are read as they are; only others are merged.

        having: values of one column of the key, under its name; only rows with one of them are merged.
        """
        state, table = state or self.state(), self.tables[name]
        runs = state.runs.get(name, [])
        if not runs:
            return self.spark.createDataFrame([], table.schema)
        most = max(r["bits"] for r in runs)
        covers = lambda r: range(r["bucket"] << most - r["bits"], (r["bucket"] + 1) << most - r["bits"])  # noqa: E731  buckets at the finest split
        count = defaultdict(int)
        for r in runs:
            for b in covers(r):
                count[b] += 1
        alone = [r for r in runs if all(count[b] == 1 for b in covers(r))]
        rest = [r for r in runs if r not in alone]
        only = lambda rows: rows if having is None else among(rows, having.columns[0], having)
        parts = [only(self._open(name, alone))] if alone else []
        if rest:
            parts.append(table.least(only(self._open(name, rest)).repartition(*table.key)))  # dealt before they are sorted
        return reduce(DataFrame.unionByName, parts)

    def _open(self, name: str, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.tables[name].schema).parquet(*[f"{self.folder}/{r['path']}" for r in runs])

    def size(self, name: str) -> int:
        return sum(r["rows"] for r in self.state().runs.get(name, []))

    # --- writing ---

    def commit(self, batch: Mapping[str, DataFrame], number: int | None = None, note: dict | None = None, sizes: Mapping[str, int] = MappingProxyType({})) -> State:
        """Add rows to tables in one step. ``number`` is the batch's own: one that is not above the last taken changes nothing, so a retry is harmless.

        sizes: of tables whose number of rows is known and which are cheap to read; others are written once to be counted.
        """
        before = self.state()
        if number is not None and number <= before.batch:
            return before
        after = State(before.number + 1, {k: list(v) for k, v in before.runs.items()}, dict(before.bits), before.batch if number is None else number, 0, 0, {**before.note, **(note or {})})
        drafts, made = [], []
        for name, rows in batch.items():
            own, n = rows.select(*self._columns(name)), sizes.get(name)
            if n is None:
                drafts.append(f"drafts/{uuid.uuid4().hex}")
                own.write.parquet(f"{self.folder}/{drafts[-1]}")
                own = self.spark.read.schema(self.tables[name].schema).parquet(f"{self.folder}/{drafts[-1]}")
                n = own.count()
            if not n:
                continue
            runs = after.runs.get(name, [])
            held = sum(r["rows"] for r in runs)
            after.bits[name] = self._bits(before.bits.get(name, 0), n + held)
            if 0 < held <= self.absorb * n:
                own, n, runs = own.unionByName(self._open(name, runs)), n + held, []
            made += (new := self._write(name, own, after.bits[name], n))
            after.written += sum(r["bytes"] for r in new)
            after.runs[name] = [*runs, *new]
            made += self._compact(name, after)
        self._publish(after)
        named = {r["path"] for runs in after.runs.values() for r in runs}
        for path in [*drafts, *(r["path"] for r in made if r["path"] not in named)]:
            self._manifests.delete(path)
        self._forget()
        return after

    def _columns(self, name: str) -> list[str]:
        return T.StructType.fromDDL(self.tables[name].schema).names

    def _bucket(self, name: str, bits: int) -> Column:
        """The first ``bits`` of the key's hash. All of the key is hashed, so rows that share a part of it spread as well."""
        return F.shiftrightunsigned(F.xxhash64(*self.tables[name].key), 64 - bits) if bits else F.lit(0).cast("long")

    def _write(self, name: str, rows: DataFrame, bits: int, n: int) -> list[dict]:
        """Write the rows that count, of about ``n``, as one sorted run for each bucket. Rows are shuffled once, by bucket: those of equal keys meet there."""
        base, table, bucket = f"{name}/{uuid.uuid4().hex}", self.tables[name], self._bucket(name, bits)
        slices = min(1 << bits, max(1, -(-n // self.slice_rows)))
        for k in range(slices):
            some = rows.where(bucket % slices == k) if slices > 1 else rows
            bucketed = some.withColumn("_bucket", bucket).repartition("_bucket")
            put(table.least(bucketed, "_bucket").sortWithinPartitions("_bucket", *table.key), f"{self.folder}/{base}", "_bucket")
        if not self._manifests.found(f"{base}/_bucket=*"):
            return []  # no rows
        counted = self.spark.read.parquet(f"{self.folder}/{base}").groupBy("_bucket").agg(F.count("*")).collect()  # one row a bucket
        run = lambda b: f"{base}/_bucket={b}"
        return [{"path": run(b), "bucket": int(b), "bits": bits, "rows": n, "bytes": self._manifests.length(run(b))} for b, n in counted]

    def _tier(self, run: dict) -> int:
        return max(0, math.floor(math.log(max(1, run["rows"] / self.tier_rows), self.fan)))

    def _compact(self, name: str, state: State) -> list[dict]:
        """Merge the runs of buckets in which enough of one tier have gathered, and split all runs of fewer bits once the table has outgrown them; the runs made."""
        made, due = [], [r for r in state.runs[name] if r["bits"] < state.bits[name]]
        while True:
            for runs in self._by_bucket(state.runs[name]).values():
                tiers = defaultdict(list)
                for r in runs:
                    tiers[self._tier(r)].append(r)
                due += [r for found in tiers.values() if len(found) >= self.fan for r in found if r not in due]
            if not due:
                return made
            new = self._write(name, self._open(name, due), state.bits[name], sum(r["rows"] for r in due))
            state.rewritten += sum(r["bytes"] for r in new)
            state.runs[name] = [r for r in state.runs[name] if r not in due] + new
            made, due = made + new, []

    def _bits(self, bits: int, rows: int) -> int:
        """As many bits as keep a bucket within its rows; never fewer than before."""
        while rows > self.bucket_rows << bits:
            bits += 1
        return bits

    @staticmethod
    def _by_bucket(runs: list[dict]) -> dict[tuple[int, int], list[dict]]:
        out = defaultdict(list)
        for r in runs:
            out[r["bits"], r["bucket"]].append(r)
        return out
