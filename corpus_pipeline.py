"""A training-corpus pipeline over ``documents``: five stages, each a DataFrame of what the one before kept.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``. Its result
is written as Parquet and read again by the next stage, which cuts lineage: a
lost executor only repeats tasks of the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontocat.llm import decontaminate, mixing, ngram_join, quality, sharding
from ontocat.llm.common import read, shipped
from ontocat.session import new_snapshot_path

#: Near duplicates among training documents: five-word n-grams, similarity of 0.8 or more.
NGRAM = 5
SIMILARITY = (80, 100)


@shipped
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


@shipped
def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return ngram_join.one_of_each(docs, ngram=NGRAM, similarity=SIMILARITY)


@shipped
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target takes them."""
    return mixing.mixture(docs)


@shipped
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    placed = sharding.shard_documents(docs)
    return placed.select(*[c for c in docs.columns if c not in ("shard", "slot")], "placed.shard", "placed.slot")


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", join_near_copies), ("benchmark decontamination", remove_benchmark),
          ("mixing sources to target weights", mix_sources), ("sharding", shard)]

#: The classifier's stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a Parquet table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = new_snapshot_path(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
