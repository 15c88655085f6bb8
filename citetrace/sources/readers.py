"""Sources: notice CSV, result CSV, nested works, citation records, id mappings."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetrace.functions import identifiers as ids
from citetrace.plans.storage import materialise

WORK = (
    "id string, doi string, display_name string, title string, publication_date string, publication_year int, type string, type_crossref string, "
    "is_retracted boolean, cited_by_count int, referenced_works array<string>, primary_location struct<source: struct<id: string, display_name: string>>, "
    "primary_topic struct<id: string, display_name: string, domain: struct<display_name: string>>"
)
CITATION = "citing string, cited string, creation string"


def trimmed(rows: DataFrame) -> DataFrame:
    """All columns as text, names and cells trimmed, blank and ``NA`` null."""
    cell = lambda c: F.nullif(ids.as_text(F.col(f"`{c}`")), F.lit("NA"))
    return rows.select(*[cell(c).alias(c.strip()) for c in rows.columns])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record): the records of CSV files, quoted cells with their line ends whole, however many tasks read a file.

    Lines are read by byte ranges. Whether a line begins a record follows from the quotes before it: each range gives how many quotes it has, odd or even, and
    where its last record begins, and a pass over the ranges, one row each, says with what each begins. ``at`` grows with the place in the file. A byte order
    mark at a file's beginning goes; bytes that are no UTF-8 become U+FFFD. A quote that is never closed holds the rest of its file, as in any reader.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value")
    )
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")
    lines = lines.withColumn("value", F.make_valid_utf8("value")).withColumn("quotes", quotes)
    inner = Window.partitionBy("file", "block").orderBy("line")
    upto = lines.withColumn("before", F.coalesce(F.sum("quotes").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # of a range: its quotes, and its last line that begins a record if the range begins outside quotes (even) or inside them (odd)
    begins = lambda odd: F.max(F.when((F.col("before") + odd) % 2 == 0, F.col("line")))
    ranges = upto.groupBy("file", "block").agg(F.sum("quotes").alias("sum"), begins(0).alias("even"), begins(1).alias("odd"))
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("odd_before", F.coalesce(F.sum("sum").over(past), F.lit(0)) % 2)
    own = F.when(F.col("odd_before") == 0, F.struct("block", F.col("even").alias("line"))).otherwise(F.struct("block", F.col("odd").alias("line")))
    ranges = ranges.withColumn("last", F.when(own["line"].isNotNull(), own))
    ranges = ranges.withColumn("open", F.last("last", ignorenulls=True).over(past)).select("file", "block", "odd_before", "open")
    placed = upto.join(F.broadcast(ranges), ["file", "block"])  # one row a range of a file
    start = (F.col("before") + F.col("odd_before")) % 2 == 0
    head = F.last(F.when(start, F.struct("block", "line")), ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    keyed = placed.select("file", F.coalesce(head, "open").alias("at"), F.struct("block", "line").alias("place"), "value")
    whole = keyed.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("lines"))  # the lines of one record
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    first = F.col("at")["block"] == 0
    text = F.when(first, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return whole.select("file", "at", F.regexp_replace(text, "\r$", "").alias("record"))


def notice_csv(spark: SparkSession, path: str) -> DataFrame:
    """Notice rows of CSV files with a header; quoted cells may hold line ends, and a file is read in parallel. Blank lines are no rows.

    The columns are those of the first file's header; a record with fewer cells has nulls, one with more loses the rest.
    """
    records = materialise(csv_records(spark, path), "csv-records")
    least = records.groupBy("file").agg(F.min("at").alias("at"))
    header = records.join(least, ["file", "at"], "left_semi").orderBy("file").select("record").first()
    if header is None:
        return spark.createDataFrame([], "_c0 string")
    names = _cells(header[0])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    body = records.join(least, ["file", "at"], "left_anti").where(F.trim("record") != "")
    row = F.from_csv("record", ", ".join(f"{f.name} string" for f in schema), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"})
    cells = body.select(row.alias("r"))
    return trimmed(cells.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)]))


def _cells(record: str) -> list[str]:
    """The cells of one record, as names of columns: an empty one has its number, one that is there before gets it added."""
    cells = next(csv.reader(io.StringIO(record, newline="")), [])
    out: list[str] = []
    for i, c in enumerate(c.strip() for c in cells):
        out.append(f"_c{i}" if not c else f"{c}{i}" if c in out else c)
    return out


def result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table that may not exist: then it is empty. The schema is given, never inferred."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).option("header", True).csv(path)


def works_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Works of nested documents; what a document lacks is null, and one that does not parse gives a null node_id."""
    w = rows.select(F.from_json(F.col(column), WORK).alias("w"), F.col(column).alias("raw_json"))
    refs = F.filter(F.transform("w.referenced_works", ids.compact_id), lambda x: x.isNotNull())
    return w.select(
        ids.compact_id(F.col("w.id")).alias("node_id"),
        ids.doi(F.col("w.doi")).alias("doi"),
        F.coalesce(ids.as_text(F.col("w.display_name")), ids.as_text(F.col("w.title"))).alias("title"),
        ids.parse_date(F.col("w.publication_date")).alias("publication_date"),
        F.col("w.publication_year").alias("publication_year"),
        F.coalesce("w.type", "w.type_crossref").alias("work_type"),
        F.coalesce("w.is_retracted", F.lit(False)).alias("is_retracted"),
        F.col("w.cited_by_count").alias("cited_by_count"),
        ids.compact_id(F.col("w.primary_location.source.id")).alias("source_id"),
        F.col("w.primary_location.source.display_name").alias("source_name"),
        ids.compact_id(F.col("w.primary_topic.id")).alias("topic_id"),
        F.col("w.primary_topic.display_name").alias("topic_name"),
        F.col("w.primary_topic.domain.display_name").alias("topic_domain"),
        refs.alias("referenced_works"),
        "raw_json",
    )


def citations_from_pids(rows: DataFrame, citing: Column, cited: Column, creation: Column) -> DataFrame:
    """Typed citations of index records whose ends are lists such as ``doi:… pmid:…``."""
    return rows.select(
        ids.doi(ids.pid(citing, "doi")).alias("citing_doi"),
        ids.pmid(ids.pid(citing, "pmid")).alias("citing_pmid"),
        ids.doi(ids.pid(cited, "doi")).alias("cited_doi"),
        ids.parse_date(creation).alias("creation_date"),
    )


def map_ids(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges of (citing, cited) pairs of an index's own ids through (index_id, node_id); unmapped ends go."""
    m = mapping.select("index_id", "node_id").dropDuplicates(["index_id"])
    a = m.select(F.col("index_id").alias("citing"), F.col("node_id").alias("source_id"))
    b = m.select(F.col("index_id").alias("cited"), F.col("node_id").alias("target_id"))
    return pairs.join(a, "citing").join(b, "cited").select("source_id", "target_id").distinct()
