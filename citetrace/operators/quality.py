"""Checks of a finished run, as rows (check_name, severity, status, observed, expected, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrace.operators import graph

# Metadata that a run must have.
REQUIRED = ("rw_snapshot_date", "oc_access_date", "pipeline_mode", "opencitations_seed_stats", "last_crawl_summary", "depth3_truncated")
FAILED_PREFIX = "opencitations_failed_parent:"


def check(one: DataFrame, name: str, severity: str, observed: Column, expected: Column | str, ok: Column, details: Column | str = "") -> DataFrame:
    """A check's row from a table of one row."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return one.select(
        F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.when(ok, "pass").otherwise("fail").alias("status"),
        observed.cast("string").alias("observed"), as_column(expected).cast("string").alias("expected"), as_column(details).cast("string").alias("details"),
    )


def missing_metadata(spark: SparkSession, metadata: DataFrame, required=REQUIRED) -> DataFrame:
    need = spark.createDataFrame([(k,) for k in required], "key string")
    return need.join(metadata.select("key"), "key", "left_anti")


def required_metadata(spark: SparkSession, metadata: DataFrame, required=REQUIRED) -> DataFrame:
    """Observed: the required keys that are there; details: those that are not."""
    need = spark.createDataFrame([(i, k) for i, k in enumerate(required)], "i int, key string")
    seen = need.join(metadata.select("key").distinct().withColumn("there", F.lit(True)), "key", "left")
    here = seen.agg(  # as many rows as there are required keys
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("there"), F.col("key")))), ";").alias("have"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.struct("i", "key")))), lambda x: x["key"]), ";").alias("gone"),
    )
    details = F.when(F.col("gone") == "", "").otherwise(F.concat(F.lit("Missing: "), "gone"))
    return check(here, "required_metadata", "major", F.col("have"), ";".join(required), F.col("gone") == "", details)


def duplicate_groups(seed_rows: DataFrame) -> DataFrame:
    return seed_rows.where("node_id is not null").groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_canonical(canonical: DataFrame, seed_rows: DataFrame) -> DataFrame:
    n = duplicate_groups(canonical).agg(F.count("*").alias("n"))
    status, node = F.col("resolved_status"), F.col("node_id")
    seen = seed_rows.agg(F.count_if(status == "resolved").alias("records"), F.count_distinct(F.when(status == "resolved", node)).alias("papers"), F.count_if(node.isNotNull() & (status != "resolved")).alias("linked"))
    details = F.concat(F.lit("resolved records "), "records", F.lit(", resolved papers "), "papers", F.lit(", linked duplicates "), "linked")
    return check(n.crossJoin(seen), "duplicate_canonical_seed_records", "major", F.col("n"), "0", F.col("n") == 0, details)


def stored_vs_exported(edges: DataFrame, frontier: DataFrame, k: int) -> DataFrame:
    s = graph.edge_scope(edges, frontier, k)
    details = F.concat(F.lit("without a source "), "missing_source", F.lit(", without a target "), "missing_target")
    return check(s, "stored_vs_exported_edges", "major", F.col("exported_edges"), F.col("stored_edges"), F.col("exported_edges") == F.col("stored_edges"), details)


def frontier_processed(frontier: DataFrame, k: int) -> DataFrame:
    n = frontier.where(F.col("depth") < k).agg(F.count_if(~F.col("processed")).alias("n"))
    return check(n, f"frontier_processed_for_depth{k}_claim", "major", F.col("n"), "0", F.col("n") == 0, f"parents of depth below {k} that wait")


def failed_parents(metadata: DataFrame) -> DataFrame:
    n = metadata.where(F.col("key").startswith(FAILED_PREFIX)).agg(F.count("*").alias("n"))
    return check(n, "opencitations_failed_parents", "moderate", F.col("n"), "0", F.col("n") == 0, "parents whose citations could not be had")


def any_label(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Whether some row has a value in one of the columns."""
    there = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNotNull()
    one = rows.agg(F.count_if(there).alias("n"), F.count("*").alias("all"))
    return check(one, name, "moderate", F.col("n") > 0, "true", F.col("n") > 0, F.concat("n", F.lit(" of "), "all", F.lit(" rows")))


def manifest_matches(manifest: DataFrame) -> DataFrame:
    """The counts of a written graph's manifest (``sinks.manifest`` over ``sinks.read_manifest``) against those of the tables."""
    ok = (F.col("expected_nodes") == F.col("written_nodes")) & (F.col("expected_edges") == F.col("written_edges"))
    seen = F.concat_ws("/", "written_nodes", "written_edges")
    return check(manifest, "full_graph_export", "major", seen, F.concat_ws("/", "expected_nodes", "expected_edges"), ok, "nodes and edges of the written graph")


def outputs_exist(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row for each expected output: whether its folder exists and holds rows."""
    rows = []
    for name, path in sorted(paths.items()):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        rows.append((name, bool(there) and bool(spark.read.parquet(path).limit(1).count())))
    out = spark.createDataFrame(rows, "name string, there boolean")
    return out.select(
        F.concat(F.lit("output_exists:"), "name").alias("check_name"), F.lit("major").alias("severity"), F.when(F.col("there"), "pass").otherwise("fail").alias("status"),
        F.col("there").cast("string").alias("observed"), F.lit("true").alias("expected"), F.lit("the table is there and has rows").alias("details"),
    )


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
