"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Clean, distinct and unleaked documents are mixed to target weights and dealt to shards. A stage
judges all rows that its predecessor kept; its own decisions are final. The first four return the
columns of documents, the last adds shard and slot.

Rows without doc_id pass the near-duplicate stage (they can't be named); null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from tallyforge.llm.base import Shared, table

N_SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the toxicity network; tests/llm/test_pipeline.py replays the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result lies in the shared folder before the next begins."""
    shared, docs = Shared(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), name)
    return docs
