"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of documents; the last one adds `shard`. A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import materialise
from gleaner.llm.decontaminate import clean_documents
from gleaner.llm.jaccard import without_near_copies
from gleaner.llm.mixing import mixed_documents
from gleaner.llm.quality import accepted_documents
from gleaner.llm.sharding import sharded_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to equal token budgets, half of all tokens together."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard."""
    return sharded_documents(docs)


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_copies), ("benchmark decontamination", decontamination), ("mixing sources", mixing), ("sharding", sharding)]
#: The first stages can't be said in SQL: their results are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
