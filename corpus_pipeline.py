"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding; each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import sharding, stages
from shelfspark.llm.common import new_path

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("sharding", stages.sharding),
]

#: None: fingerprints and hashed n-grams have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last make of the documents table, each read from what the one before wrote."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{out}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole documents table: where each row goes."""
    return STAGES[-1][1](spark, _mixed(spark, sf_dir), sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The pipeline over the whole documents table, its rows written to their shards at `path` and read back: row, shard."""
    return sharding.write_shards(_mixed(spark, sf_dir), path)
