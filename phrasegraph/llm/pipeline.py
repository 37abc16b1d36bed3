"""From raw documents to shards: toxicity, near-duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.durable import durable, settled
from ..plans.skew import within_reach
from . import decontaminate, minhash, mixing, sharding, toxicity
from .common import small_batches, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the given ids; rows with a null id stay.

    The ids are written; texts move only if there are too many ids to broadcast.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        gone = settled(spark, lambda: ids.select("doc_id").filter("doc_id is not null").distinct())
    return docs.join(within_reach(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; the model learns from the labelled rows among ``docs``."""
    with small_batches(spark):
        model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(docs, model).filter("score >= 0.3"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays: sets of five-word shingles with a similarity of 0.8 or more."""
    return _without(docs, minhash.near_duplicates(docs, size=5, percent=80).filter("not kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probability stay: half of the tokens are expected to."""
    return mixing.mix(docs).filter("mix_sampled").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document that is left."""
    placed = sharding.assign_shards(docs, shards=8, seed=42)
    return placed.select("doc_id", "size", "text_crc32", "row_number", "position", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is learned and the third is not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
