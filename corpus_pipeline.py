"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, mixing and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontamination, mixing, ngram_jaccard, sharding, toxicity
from cadenza.llm.common import materialize, table


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word n-grams, similarity of 0.8 or more."""
    return ngram_jaccard.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return sharding.report(docs)


STAGES = [("toxicity", detoxify), ("ngram_jaccard", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: The toxicity model is trained, so SQL cannot express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
