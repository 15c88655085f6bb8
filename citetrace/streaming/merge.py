"""Incremental citation ingest: files of observations taken into a store of edge runs by the least-depth rule.

The merge keeps the shallowest observation, then the smallest seq, so any split into batches and any retry gives the same edges. An inbox may also say which
parents failed: a row without a source whose ``error`` is set. A parent is failed if the last that is known of it, by seq, is a failure; any observation of its
citations clears it. Edges and failures of a batch are one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citetrace.plans.log_store import LogStore, Table


def store(spark: SparkSession, folder: str, schema: str, **sizes: int) -> LogStore:
    """The store below a folder. schema: of the observations; ``error`` is no column of an edge.

    Edges are read whole, so a batch that is at least half as large as the store is merged with it at once, and reading has nothing to shuffle.
    """
    columns = [f for f in T.StructType.fromDDL(schema).fields if f.name != "error"]
    edges = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    tables = {"edges": Table(edges, ("target_id", "source_id"), ("depth", "seq")), "failures": Table("node_id string, error string, seq long", ("node_id",), ("-seq", "error"))}
    return LogStore(spark, f"{folder}/store", tables, **{"absorb": 2} | sizes)


def ingest(spark: SparkSession, inbox: str, folder: str, schema: str, max_files: int = 2, **sizes: int) -> DataFrame:
    """Take all waiting files of ``inbox`` and return the edges so far. The store and the checkpoint are below ``folder``.

    A batch writes its own observations, with the edges so far if they are not many more, and, now and then, merges like-sized runs, so what it writes follows what it
    brings. A batch that is tried again is taken once. Files that were there when this returned are not read again and may go.
    """
    own = store(spark, folder, schema, **sizes)

    def take(batch: DataFrame, epoch: int) -> None:
        rows = batch if "error" in batch.columns else batch.withColumn("error", F.lit(None).cast("string"))
        events = rows.where("source_id is not null or error is not null")
        state = events.select(F.col("target_id").alias("node_id"), F.when(F.col("source_id").isNull(), F.col("error")).alias("error"), "seq")
        state = state.where("node_id is not null")
        # the batch is files, so counting it is cheap and it need not be written to be counted
        n = rows.agg(F.count("source_id"), F.count_if(F.col("target_id").isNotNull() & (F.col("source_id").isNotNull() | F.col("error").isNotNull()))).first()
        own.commit({"edges": rows.where("source_id is not null"), "failures": state}, number=epoch, sizes=dict(zip(("edges", "failures"), n, strict=True)))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(inbox)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return own.read("edges")


def failures(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(node_id, error) of parents that failed and have not succeeded since."""
    return store(spark, folder, schema).read("failures").where("error is not null").select("node_id", "error")


def clear_failures(metadata: DataFrame, succeeded: DataFrame, prefix: str) -> DataFrame:
    """``metadata`` without the failure rows of parents that succeeded since."""
    keys = succeeded.select(F.concat(F.lit(prefix), "node_id").alias("key"))
    return metadata.join(keys, "key", "left_anti")
