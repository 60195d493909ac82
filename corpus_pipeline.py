"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of documents. Part of the subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioloom.llm import decontam, mixing, neardup, quality, sharding
from folioloom.llm.common import working, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the compression bands reject go."""
    return quality.keep(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. A link is a similarity of 0.8 over
    runs of five words, or op5's. Rows go and not ids: a row goes only if one of its group stays."""
    return neardup.unique(docs, (neardup.OP5, neardup.STAGE))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot."""
    return sharding.pack_rows(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents. A stage's own tables go once its result is written, and all but the last result at the
    end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with working(spark) as results:
        for name, stage in STAGES:
            with working(spark) as tables:
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
                tables.keep(docs)
        results.keep(docs)
    return docs


#: Compression and near-duplicate links have no SQL form.
ORACLE_SQL = None
