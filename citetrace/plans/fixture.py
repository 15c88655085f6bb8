"""The citation graph derived from the order tables: works are orders, citations link orders that share a part."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citetrace.operators import components, control, crawl, graph, reach, seeds
from citetrace.plans import analysis
from citetrace.plans.keyed_table import KeyedTable
from citetrace.plans.storage import delete, folder, materialise, put, shared_dir, written
from citetrace.sources import dumps
from citetrace.streaming import merge


@dataclass(frozen=True)
class Fixture:
    """Tables of the derived graph, each declared once. Those that many queries share are written once and read back."""

    spark: SparkSession
    sf_dir: str
    stores: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def base_works(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        day = F.col("o_orderdate").cast("date")
        return o.join(c, o.o_custkey == c.c_custkey, "left").select(
            F.concat(F.lit("W"), "o_orderkey").alias("node_id"),
            F.concat(F.lit("10.1000/w"), "o_orderkey").alias("doi"),
            F.concat(F.lit("Order "), "o_orderkey").alias("title"),
            F.when(F.col("o_orderkey") % 97 != 0, day).alias("publication_date"),
            F.when(F.col("o_orderkey") % 97 != 0, F.year(day)).alias("publication_year"),
            F.col("o_orderstatus").alias("work_type"),
            F.col("o_orderpriority").alias("topic_domain"),
            F.col("c_mktsegment").alias("topic_name"),
            F.col("c_name").alias("source_name"),
        )

    @cached_property
    def works(self) -> DataFrame:
        return seeds.propagate_retracted(self.base_works, self.seed_records)

    @cached_property
    def raw_citations(self) -> DataFrame:
        item = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_shipdate").cast("date").alias("citation_date"),
            F.lag("l_orderkey", 1).over(item).alias("one"), F.lag("l_orderkey", 2).over(item).alias("two"),
        )
        cited = lines.select("*", F.posexplode(F.array("one", "two")).alias("k", "cited")).where("cited is not null and cited <> l_orderkey")
        rows = cited.select(
            F.concat(F.lit("W"), "l_orderkey").alias("source_id"),
            F.concat(F.lit("W"), "cited").alias("target_id"),
            F.when(F.col("l_returnflag") == "R", "opencitations").otherwise("openalex").alias("source_api"),
            "citation_date",
            ((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.col("k")) * 1_000_000 + F.col("l_partkey")).alias("seq"),
        )
        path = folder(self.spark, "citations")
        put(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def seed_records(self) -> DataFrame:
        o = self.table("orders").where("o_orderkey % 200 = 0")
        day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
        record = lambda mark, kind, days: [
            F.concat(F.lit("R"), key, F.lit(mark)).alias("record_id"), F.lit(kind).alias("notice_type"), F.date_add(day, days).alias("notice_date"),
            day.alias("original_paper_date"), F.concat(F.lit("10.1000/w"), key).alias("original_doi"), F.concat(F.lit("Order "), key).alias("title"),
            F.concat(F.lit("W"), key).alias("node_id"), F.lit("resolved").alias("resolved_status"),
        ]
        return o.select(*record("", "Retraction", 180)).unionByName(o.where("o_orderkey % 1000 = 0").select(*record("B", "Expression of concern", 120)))

    @cached_property
    def seed_rows(self) -> DataFrame:
        """Seeds with one resolved record for each paper."""
        return seeds.mark_duplicates(self.seed_records)

    @cached_property
    def canonical(self) -> DataFrame:
        return seeds.canonical(self.seed_rows)

    @cached_property
    def frontier(self) -> DataFrame:
        nodes = graph.bfs(self.raw_citations, self.seed_records.select("node_id"), 2)
        return materialise(nodes.withColumn("processed", F.col("depth") < 2), "frontier")

    @cached_property
    def edges(self) -> DataFrame:
        return materialise(graph.level_edges(self.raw_citations, self.frontier, 2), "edges")

    @cached_property
    def scoped_edges(self) -> DataFrame:
        """All citations with a depth, also those whose source is outside the frontier, and some of a stale target."""
        return materialise(graph.level_edges(self.raw_citations, self.frontier, 3), "scoped-edges")

    @cached_property
    def measured(self) -> DataFrame:
        return materialise(reach.seed_metrics(self.canonical, self.numbered_nodes, self.numbered_edges), "seed-metrics")

    @cached_property
    def numbered_nodes(self) -> DataFrame:
        return reach.number_nodes(self.frontier, self.works, self.canonical)

    @cached_property
    def numbered_edges(self) -> DataFrame:
        return reach.number_edges(self.edges, self.numbered_nodes)

    @cached_property
    def paired(self) -> DataFrame:
        """Seeds with their matched controls and both shares."""
        found = control.match(control.seed_frame(self.seed_rows, self.edges, self.works), control.pool(self.edges, self.frontier, self.works))
        return materialise(control.pairs(found, self.edges, self.works), "matched-pairs")

    def streamed(self, observations: Callable[[Fixture], DataFrame], failed: Callable[[Fixture], DataFrame]) -> str:
        """The folder of a store that a stream of both has filled. They come in two deliveries; what the stream has taken of one goes before the next is written."""
        if "streamed" not in self.stores:
            base = folder(self.spark, "stream")
            rows = observations(self).select("source_id", "target_id", "depth", "source_api", "citation_date", "seq", F.lit(None).cast("string").alias("error"))
            both = rows.unionByName(failed(self))
            delivery = F.pmod(F.xxhash64(F.coalesce("source_id", "target_id"), "source_api"), F.lit(2))  # of about half of all edges both observations are in one
            for n in range(2):
                delete(self.spark, f"{base}/inbox")
                put(both.where(delivery == n), f"{base}/inbox")  # as many files as the rows need
                files = len(self.spark.read.parquet(f"{base}/inbox").inputFiles())
                merge.ingest(self.spark, f"{base}/inbox", base, ", ".join(f"{c} {t}" for c, t in both.dtypes), max_files=files)
            self.stores["streamed"] = base
        return self.stores["streamed"]

    def crawled(self) -> crawl.Crawl:
        """A crawl of the derived citations in three batches, with a stop between two levels."""
        if "crawl" not in self.stores:
            base = folder(self.spark, "crawl")
            part = lambda k: self.raw_citations.where(f"seq div 1000000 % 3 = {k}")
            first = crawl.Crawl(self.spark, base)
            first.add_roots(self.seed_records)
            first.add_citations(part(0), number=0)
            first.step()
            first.add_citations(part(1), number=1)
            again = crawl.Crawl(self.spark, base)  # takes up where the first stopped
            again.run()
            again.add_citations(part(2), number=2)
            again.run()
            self.stores["crawl"] = base
        return crawl.Crawl(self.spark, self.stores["crawl"])

    @property
    def labelled(self) -> components.Components:
        """Components of the edges, taken in three batches."""
        if "labels" not in self.stores:
            base = folder(self.spark, "labels")
            for n in range(3):
                components.Components(self.spark, base).add(self.edges.where(f"pmod(xxhash64(source_id, target_id), 3) = {n}"), number=n)
            self.stores["labels"] = base
        return components.Components(self.spark, self.stores["labels"])

    def analysed(self, metadata: DataFrame) -> dict[str, str]:
        """What one call of the whole analysis has written, over tables that were exported to a folder first."""
        if "analysis" not in self.stores:
            base = folder(self.spark, "analysis")
            tables = {"seeds": self.seed_rows, "works": self.works, "frontier_nodes": self.frontier, "citation_edges": self.edges, "run_metadata": metadata}
            for name, table in tables.items():
                table.write.parquet(f"{base}/in/{name}")
            self.outputs.update(analysis.analyse(self.spark, f"{base}/in", f"{base}/out"))
            self.stores["analysis"] = base
        return self.outputs

    def dumped(self) -> str:
        """A folder of archives of all citations, as an index's dump has them."""
        if "dump" not in self.stores:
            base = folder(self.spark, "dump")
            rows = self.raw_citations.select(F.col("seq").cast("string").alias("oci"), F.col("source_id").alias("citing"), F.col("target_id").alias("cited"), F.col("citation_date").cast("string").alias("creation"))
            dumps.write(rows, base, member_rows=50_000)
            self.stores["dump"] = base
        return self.stores["dump"]

    @cached_property
    def upserted(self) -> KeyedTable:
        """Each node's last citation by seq, put in three batches that touch the same nodes; nodes whose number ends in 9 are deleted."""
        table = KeyedTable(self.spark, folder(self.spark, "upserts"), "node_id string, source_api string, citation_date date, seq long", ["node_id"], file_rows=20_000)
        rows = self.raw_citations.select(F.col("source_id").alias("node_id"), F.when(F.col("seq") % 7 != 0, F.col("source_api")).alias("source_api"), "citation_date", "seq")
        line = F.floor(F.col("seq") / 10_000_000) % 100  # grows with seq within a node
        for n, some in enumerate((line <= 2, (line > 2) & (line <= 4), line > 4)):
            table.upsert(rows.where(some), order=["seq"], number=n)
        table.delete(rows.select("node_id").where("node_id like '%9'"), number=3)
        return table


_fixtures: dict[tuple, Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """The derived tables of a folder, one for each application and state of its files, so that its queries share them. What has been released is made again."""
    key = spark.sparkContext.applicationId, sf_dir, signature(spark, sf_dir)
    if key not in _fixtures:
        for old in [k for k in _fixtures if k[:2] == key[:2]]:
            del _fixtures[old]
        _fixtures[key] = Fixture(spark, sf_dir)
    x, known = _fixtures[key], set(written(spark))
    for name, value in list(vars(x).items()):
        if isinstance(value, DataFrame) and not _held(value, known):
            del vars(x)[name]
    if not known.issuperset(x.stores.values()) or ("upserted" in vars(x) and vars(x)["upserted"].folder not in known):
        vars(x).pop("upserted", None)
        x.stores.clear()
    return x


def _held(df: DataFrame, known: set[str]) -> bool:
    """Whether all that ``df`` reads of what this application has written is still there."""
    plain = lambda path: re.sub(r"^\w+:/*", "/", path)
    base = plain(shared_dir(df.sparkSession)) + "/"
    tops = {base + p[len(base) :].split("/")[0] for p in map(plain, df.inputFiles()) if p.startswith(base)}
    return tops <= set(map(plain, known))


def signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of a folder of tables."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for pattern in ("*.parquet", "*.parquet/*") for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{pattern}")) or []]
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))
