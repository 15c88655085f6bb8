"""Running sums over all rows in an order, without one task for all: ranges of rows, each summed apart, and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before in ``order``, 0 for the first."""
    return running_sums(rows, order, {name: value})


def running_sums(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name, the sum of its value over all rows before in ``order``, 0 for the first; all in one pass.

    Rows are dealt into ranges of the order by sampled bounds, so keys with a common prefix spread as well; the ranges are written
    with their number, so that both passes see the same ones. The offsets are one row a range, the ordered pass one task a range. Equal
    rows of the order are in one range.
    """
    spark = rows.sparkSession
    parts, names = int(spark.conf.get("spark.sql.shuffle.partitions")), list(values)
    own = rows.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    ranged = materialise(own.repartitionByRange(parts, *order).withColumn("_r", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_r").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_r", *[F.coalesce(F.sum(f"_t{i}").over(upto), F.lit(0)).alias(f"_b{i}") for i in range(len(names))])
    inner = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "_r")
    sums = [(F.col(f"_b{i}") + F.coalesce(F.sum(f"_v{i}").over(inner), F.lit(0))).alias(n) for i, n in enumerate(names)]
    return placed.select(*rows.columns, *sums)
