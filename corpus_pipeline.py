"""The corpus pipeline: five of the library's operators over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollkeep.llm.decontaminate import remove_contaminated
from rollkeep.llm.mixing import mix_documents
from rollkeep.llm.sharding import shard_by_bytes
from rollkeep.llm.simhash import keep_one
from rollkeep.llm.storage import materialize
from rollkeep.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorization machine rejects."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Documents that share so many of a hundred of their shingles are near-duplicates, found by their fingerprints or not.
SIMILAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: linked by SimHash, or by their shared shingles."""
    return keep_one(docs, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target weight asks for."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into 16 shards of near equal size."""
    return shard_by_bytes(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL has neither the trained scores nor the linking of fingerprints; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in order, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
