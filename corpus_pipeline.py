"""A training corpus from raw documents, in five stages.

Each stage takes all that the stage before kept: (1) documents that the quality classifier rejects go; (2) one document
of each class of near duplicates stays; (3) documents that hold a benchmark item go; (4) sources are mixed to their
target weights, so a document may be left out or occur twice; (5) every row gets its shard.

All stages but the last return the columns they were given. Tables without rows pass through as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitweave.llm import decontam, mixing, neardup, quality, sharding
from hitweave.llm.registry import query, read
from hitweave.session import write_table

SHARDS = 16

# some stages learn or sample, which SQL cannot express
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def add_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.add_shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", add_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
