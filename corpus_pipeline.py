"""From raw documents to balanced shards: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``docs`` (the last one returns the shard assignment). ``run`` stores every stage's
result as Parquet and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merchantscope.llm.common import stage_table, table
from merchantscope.llm.decontaminate import drop_contaminated
from merchantscope.llm.minhash import drop_near_duplicates
from merchantscope.llm.mixing import mix_documents
from merchantscope.llm.quality import keep_good
from merchantscope.llm.sharding import histogram_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each pass that takes them."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return histogram_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
    ("sharding", shard),
]

#: The trained classifier has no SQL; tests check the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
