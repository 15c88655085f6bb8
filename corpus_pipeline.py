"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the one before kept and returns their columns; the last returns packed pieces. Of all stages: an empty
table gives no rows, other columns pass through whatever their names, repeated rows are rows of their own, texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrace.llm import decontaminate, ngram_join, packing, quality, substrings
from citetrace.plans.storage import materialise, release, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null, empty or blank text goes; a row of a null id is judged by its text."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates. Rows of a null id and texts without words stay; all rows of the id that stays do."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has; n_chars follows the text. Every row stays: a null text null, a row of a null id whole."""
    cut = substrings.cut(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and rows of a null id stay; so does all without a benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and places. A null or empty text is one piece; rows of a null id are packed."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]
#: Shingle groups, matching statistics and packing are not expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; what each stage returns is written and read again, and what it made on the way is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=[*own, written(spark)[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
