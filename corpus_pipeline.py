"""A corpus pipeline: five stages, each over all that its predecessor kept.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each group of near duplicates one document stays.
3. decontaminate: documents that hold a benchmark item (or nearly) go.
4. mix: documents appear as often as their source's target weight asks for.
5. shard: every document gets a shard of near equal bytes.

Stages 1 to 4 return the columns of ``documents``; the last adds the column ``shard``.
Nulls, empty texts, repeated rows and empty tables are handled as each operator documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, jaccard, mixing, quality, sharding
from weft.llm.common import durable, table

#: Bytes that a shard should hold.
SHARD_BYTES = 32 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, target_bytes=SHARD_BYTES)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: Learned weights and drawn hashes can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs, name)
    return docs
