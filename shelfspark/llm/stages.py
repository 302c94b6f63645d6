"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> docs, all but the last with the columns they were given.

Every stage decides by rows, not by ids: null ids, ids of several rows and extra columns of any name are allowed.
Of each class of near copies exactly one row stays, whatever its id; empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fairmix, quality, setsketch, sharding as packing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go."""
    given = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(given, model).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return setsketch.one_of_each_class(docs)


#: Words of a benchmark item from which on it removes a document: phrases of up to three words stand in many.
LEAST_WORDS = 4


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAST_WORDS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them."""
    return fairmix.repeat_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and their shards."""
    return packing.even_shards(docs)
