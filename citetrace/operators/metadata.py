"""Run metadata: (key, value) rows put, read and deleted as whole tables; provenance of a run's sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrace.functions.identifiers import snapshot_label
from citetrace.operators.seeds import last_wins


def put(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, value) after ``rows`` (key, value, seq) are set in the order of seq; a set value replaces what was there, a null one too."""
    old = metadata.select("key", "value", F.lit(None).cast("long").alias("seq"))
    return last_wins(old.unionByName(rows.select("key", "value", F.col("seq").cast("long"))), ["key"], (F.col("seq").isNotNull(), F.col("seq"))).select("key", "value")


def get(metadata: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    """(key, value) of each asked key; ``default`` where it is not set or null."""
    return keys.select("key").distinct().join(metadata, "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))


def delete(metadata: DataFrame, keys: DataFrame) -> DataFrame:
    return metadata.join(keys.select("key"), "key", "left_anti")


def provenance(run: DataFrame, path: Column, mode: str, today: Column, citations: bool = True, works: bool = False) -> DataFrame:
    """(key, value) rows of a run's sources, from a table of one row: snapshot label of the notice file, access dates, pipeline mode."""
    pairs = [("pipeline_mode", F.lit(mode)), ("rw_snapshot_date", F.coalesce(snapshot_label(path), F.lit("unknown")))]
    if citations:
        pairs.append(("oc_access_date", today.cast("string")))
    pairs.append(("openalex_access_date", today.cast("string") if works else F.lit("not used")))
    return run.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])).alias("_x")).select("_x.*")
