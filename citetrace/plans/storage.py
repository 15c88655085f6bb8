"""Where intermediate tables go: the shared folder of the session, never a local one on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of applications that name none, and the folders that each application has written and not released.
_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors and the driver share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="citetrace-")
        base = _own[key]
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which ``release`` knows."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files. Otherwise they stay until the driver collects its garbage, which a large heap puts off for long."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def put(df: DataFrame, path: str, *parts: str) -> None:
    """Add ``df`` to the Parquet files below ``path``, by the columns ``parts``, with as little disk as that takes: no shuffle files stay, and files are packed well."""
    with shuffles_deleted(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").partitionBy(*parts).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The folders that this application has written and not released, oldest first."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, keep: list[str] = ()) -> None:
    """Delete the folders that this application has written, but for those to keep. What reads them must have been written out before."""
    stay = []
    for path in written(spark):
        if path in keep:
            stay.append(path)
        else:
            delete(spark, path)
    _made[spark.sparkContext.applicationId] = stay
