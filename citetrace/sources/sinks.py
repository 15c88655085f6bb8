"""Sinks: Parquet and CSV tables, GraphML lines, manifest, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrace.functions.identifiers import xml_text
from citetrace.operators.ordered import running
from citetrace.plans.storage import folder


def through(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as ``parquet`` or ``csv`` (header, nulls empty) in the shared folder and read back with its schema."""
    path = folder(df.sparkSession, kind)
    if kind == "csv":
        df.write.option("header", True).csv(path)
        return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def export(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _data(key: str, c: Column) -> Column:
    value = c.cast("string")
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f'<data key="{key}">'), xml_text(value), F.lit("</data>")))


# Attributes of the graph file, with their types.
NODE_KEYS = (("depth", "int"), ("doi", "string"), ("title", "string"), ("publication_year", "int"), ("work_type", "string"), ("source_name", "string"), ("topic_domain", "string"), ("topic_name", "string"))
EDGE_KEYS = (("depth", "int"), ("source_api", "string"), ("citation_date", "string"))
HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    *(f'<key id="n_{k}" for="node" attr.name="{k}" attr.type="{t}"/>' for k, t in NODE_KEYS),
    *(f'<key id="e_{k}" for="edge" attr.name="{k}" attr.type="{t}"/>' for k, t in EDGE_KEYS),
    '<graph id="G" edgedefault="directed">',
)
TAIL = ("</graph>", "</graphml>")


def node_lines(nodes: DataFrame) -> DataFrame:
    """(ord, line): a GraphML element for each node; null and empty values have no data element."""
    line = F.concat(F.lit('<node id="'), xml_text(F.col("node_id")), F.lit('">'), *[_data(f"n_{k}", F.col(k)) for k, _ in NODE_KEYS], F.lit("</node>"))
    return nodes.select(F.col("node_id").alias("ord"), line.alias("line"))


def numbered(edges: DataFrame) -> DataFrame:
    """``edges`` with n from 1 in (source_id, target_id) order."""
    placed = running(edges, [F.col("source_id"), F.col("target_id")], F.lit(1), "_n")
    return placed.withColumn("n", (F.col("_n") + 1).cast("long")).drop("_n")


def edge_lines(edges: DataFrame) -> DataFrame:
    """(ord, line): a GraphML element for each edge, ids e1, e2, … in (source, target) order."""
    line = F.concat(
        F.lit('<edge id="e'), F.col("n").cast("string"), F.lit('" source="'), xml_text(F.col("source_id")), F.lit('" target="'), xml_text(F.col("target_id")), F.lit('">'),
        *[_data(f"e_{k}", F.col(k)) for k, _ in EDGE_KEYS], F.lit("</edge>"),
    )
    return numbered(edges).select(F.concat(F.lit("e"), F.lpad(F.col("n").cast("string"), 19, "0")).alias("ord"), line.alias("line"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, ord, line) of a whole GraphML file; sections 1 and 4 are its head and tail."""
    spark = nodes.sparkSession
    rows = [(section, f"{i:02d}", x) for section, lines in ((1, HEAD), (4, TAIL)) for i, x in enumerate(lines)]
    frame = spark.createDataFrame(rows, "section int, ord string, line string")
    return frame.unionByName(node_lines(nodes).withColumn("section", F.lit(2))).unionByName(edge_lines(edges).withColumn("section", F.lit(3)))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Gzip text parts whose concatenation, in part order, is the GraphML file, and ``<path>.manifest`` with what the parts hold."""
    lines = graphml(nodes, edges)
    lines.repartitionByRange("section", "ord").sortWithinPartitions("section", "ord").select("line").write.mode("overwrite").option("compression", "gzip").text(path)
    spark = nodes.sparkSession
    kind = F.ltrim("value")
    back = spark.read.text(path).agg(F.count_if(kind.startswith("<node ")).alias("node_count"), F.count_if(kind.startswith("<edge ")).alias("edge_count"))
    back.write.mode("overwrite").json(f"{path}.manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: node_count and edge_count of a written graph."""
    return spark.read.schema("node_count long, edge_count long").json(f"{path}.manifest")


def manifest(nodes: DataFrame, edges: DataFrame, written: DataFrame) -> DataFrame:
    """One row: nodes and edges expected, and those of a written manifest."""
    expected = nodes.agg(F.count("*").alias("expected_nodes")).crossJoin(edges.agg(F.count("*").alias("expected_edges")))
    return expected.crossJoin(written.select(F.col("node_count").alias("written_nodes"), F.col("edge_count").alias("written_edges")))


def row_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("json"))


def group_fingerprint(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Order-independent hash of each group's distinct members: their number and the sum of their hashes, so no group is held whole."""
    each = rows.select(group, F.col(member).alias("_m")).distinct()
    part = F.conv(F.substring(F.sha2(F.col("_m"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    summed = each.groupBy(group).agg(F.count("*").alias("n"), F.sum(part).alias("s"))
    return summed.select(group, F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"))


def id_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, ids): distinct batches of ``size`` ids in their order, the last one of the rest."""
    placed = running(rows.select(F.col(key).alias("id")), [F.col("id")], F.lit(1), "_n")
    tagged = placed.select(F.floor(F.col("_n") / size).cast("long").alias("batch"), "id")
    return tagged.groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))  # ``size`` ids a group
