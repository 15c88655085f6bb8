"""A whole analysis in one call: tables of a citation graph in, result tables, the graph file, its manifest and the checks out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetrace.operators import control, graph, metrics, quality, reach, seeds, stats
from citetrace.operators.sieve import among
from citetrace.plans.storage import materialise
from citetrace.sources import sinks

# The tables of a study and the columns that the analysis reads; those that a table lacks are null.
SCHEMAS = {
    "seeds": "record_id string, title string, notice_type string, notice_date date, original_doi string, node_id string, resolved_status string",
    "works": "node_id string, doi string, title string, publication_date date, publication_year int, work_type string, is_retracted boolean, cited_by_count int, source_name string, topic_name string, topic_domain string",
    "frontier_nodes": "node_id string, depth int, processed boolean",
    "citation_edges": "source_id string, target_id string, depth int, source_api string, citation_date date",
    "run_metadata": "key string, value string",
}
NEEDED = {"seeds": ("record_id", "node_id"), "works": ("node_id",), "frontier_nodes": ("node_id", "depth"), "citation_edges": ("source_id", "target_id", "depth"), "run_metadata": ("key", "value")}


@dataclass(frozen=True)
class Tables:
    """The tables of a study. ``of`` brings frames into this shape: columns that are there are cast, others are null."""

    seeds: DataFrame
    works: DataFrame
    frontier: DataFrame
    edges: DataFrame
    metadata: DataFrame

    @classmethod
    def of(cls, frames: dict[str, DataFrame]) -> Tables:
        return cls(*[_shaped(name, frames[name]) for name in SCHEMAS])

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Tables:
        """Parquet tables below a folder, each ``<name>`` or ``<name>.parquet``. Only run_metadata may be missing: it is then empty."""
        frames = {}
        for name, schema in SCHEMAS.items():
            found = [p for p in (f"{folder}/{name}", f"{folder}/{name}.parquet") if _exists(spark, p)]
            if not found and name != "run_metadata":
                raise FileNotFoundError(f"{folder} has no table {name}")
            frames[name] = spark.read.parquet(found[0]) if found else spark.createDataFrame([], schema)
        return cls.of(frames)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _shaped(name: str, df: DataFrame) -> DataFrame:
    if missing := [c for c in NEEDED[name] if c not in df.columns]:
        raise ValueError(f"table {name} has no column {', '.join(missing)}")
    have = set(df.columns)
    if name == "frontier_nodes" and "processed" not in have:  # as a time, or unknown and then not done
        df = df.withColumn("processed", F.col("processed_at").isNotNull() if "processed_at" in have else F.lit(False))
    if name == "seeds" and "resolved_status" not in have:
        df = df.withColumn("resolved_status", F.when(F.col("node_id").isNotNull(), "resolved"))
    if name == "works" and "publication_year" not in have and "publication_date" in have:
        df = df.withColumn("publication_year", F.year("publication_date"))
    have, schema = set(df.columns), T.StructType.fromDDL(SCHEMAS[name])
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def known_works(t: Tables, canonical: DataFrame) -> DataFrame:
    """The works of the frontier and of seeds: all that results join, so that works which no crawl has reached are shuffled by none of those joins."""
    return among(t.works, "node_id", t.frontier.select("node_id").unionByName(canonical.select("node_id")))


def results(t: Tables, k: int = 2) -> Iterator[tuple[str, DataFrame]]:
    """(name, table) of all results. What several of them need is written once."""
    canonical = materialise(seeds.canonical(t.seeds), "canonical")
    t = replace(t, works=materialise(known_works(t, canonical), "known-works"))
    inside = materialise(graph.induced_edges(t.edges, t.frontier, k), "inside-edges")
    nodes = materialise(graph.induced_nodes(t.frontier, t.works, k), "inside-nodes")
    numbers = reach.number_nodes(t.frontier, t.works, canonical, k)
    numbered = numbers, reach.number_edges(inside, numbers)
    measured = materialise(reach.seed_metrics(canonical, *numbered), "seed-metrics")
    yield "nodes", nodes
    yield "edges", inside
    yield "depth_counts", metrics.depth_counts(t.frontier, k)
    yield "edge_depths", reach.edge_depths(numbered[1], k)
    yield "edges_by_api", metrics.edges_by_api(inside)
    yield "publication_dates", metrics.pubdate_coverage(nodes)
    yield "topic_distribution", metrics.topic_distribution(nodes)
    yield "seed_metrics", measured
    yield "bridge_papers", metrics.bridges(inside, t.frontier, t.works)
    yield "post_notice_timeline", metrics.post_notice_timeline(canonical, inside, t.frontier, t.works)
    yield "event_study", metrics.event_study(t.seeds, inside, t.works)
    yield "reach_quantiles", stats.quantiles(measured, "total_depth2_reach")
    yield "reach_gini", stats.gini(measured, "total_depth2_reach")
    yield "reach_ccdf", stats.ccdf(measured, "total_depth2_reach")
    yield "reach_lorenz", stats.lorenz(measured, "total_depth2_reach")
    matched = control.match(control.seed_frame(t.seeds, inside, t.works), control.pool(inside, t.frontier, t.works))
    paired = materialise(control.pairs(matched, inside, t.works), "matched-pairs")
    yield "control_pairs", paired
    yield "control_summary", control.summary(paired)
    yield "control_event_overlay", control.event_overlay(paired, inside, t.works)
    yield "summary", metrics.summary(t.seeds, t.frontier, inside, t.edges, measured, k)
    expected = t.edges.sparkSession.createDataFrame([], "node_id string, expected long")
    yield "headline", metrics.headline(t.seeds, t.seeds, t.metadata, inside, t.frontier, t.works, numbered, measured, t.edges, expected)


def run(t: Tables, out: str, k: int = 2) -> dict[str, str]:
    """Write all results below ``out``: ``tables/<name>``, ``graphs/network_depth<k>`` with its manifest, and ``checks``; the paths by name.

    Existing results are replaced. The checks are rows that say what is wrong with a run, so a study without seeds, edges or metadata has results, too.
    """
    spark, paths = t.edges.sparkSession, {}
    for name, table in results(t, k):
        paths[name] = f"{out}/tables/{name}"
        table.write.mode("overwrite").parquet(paths[name])
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    paths["graph"] = f"{out}/graphs/network_depth{k}"
    sinks.write_graphml(read["nodes"], read["edges"], paths["graph"])
    report = quality.report(
        quality.required_metadata(spark, t.metadata),
        quality.duplicate_canonical(seeds.canonical(t.seeds), t.seeds),
        quality.stored_vs_exported(t.edges, t.frontier, k),
        quality.frontier_processed(t.frontier, k),
        quality.failed_parents(t.metadata),
        quality.any_label(read["topic_distribution"], ["topic_name", "topic_domain"], "topic_labels_present"),
        quality.any_label(read["bridge_papers"], ["title"], "bridge_titles_present"),
        quality.manifest_matches(sinks.manifest(read["nodes"], read["edges"], sinks.read_manifest(spark, paths["graph"]))),
        quality.outputs_exist(spark, {name: paths[name] for name in ("seed_metrics", "bridge_papers", "topic_distribution", "depth_counts", "summary")}),
    )
    paths["checks"] = f"{out}/checks"
    report.write.mode("overwrite").parquet(paths["checks"])
    return paths


def analyse(spark: SparkSession, folder: str, out: str, k: int = 2) -> dict[str, str]:
    """``run`` over the tables below a folder."""
    return run(Tables.load(spark, folder), out, k)
