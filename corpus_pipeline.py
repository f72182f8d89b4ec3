"""A training corpus from `documents`: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, neardup, quality, sampling, sharding, tiling
from quern.session import cut, ship, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from labels outside the held-out fold."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), sampling.fold(5) != 0)
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (similarity 0.8 of five-word shingles). Candidates are near fingerprints, by
    multi-index hashing, and shared bands of signatures, which reach down to 0.8; each is verified on whole sets."""
    ship(spark)
    return neardup.drop_near_duplicates(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship(spark)
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at target weights: a document stands as often as it is taken."""
    return mixing.mixed(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every row of the mixture."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]

#: The learned scores and the fingerprints cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents to the shard table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
