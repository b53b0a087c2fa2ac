"""The corpus pipeline: quality, near duplicates, benchmark passages, mixing, shards.

Each stage takes documents (doc_id, text, lang, source and whatever other columns, whose names may clash
with none that the stages make) and works on every row that the one before it kept. Null texts are empty
ones, null ids rows like others; rows that repeat id and text are one document to the near-duplicate
stage, and share one fate in the others; an empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm import decontaminate, mixing, near, quality, sharding
from ferrolith.llm._common import shared_dir


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of Jaccard similarity 0.8 or more."""
    return near.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, each as often as it is drawn, written by its shards and in their shuffled order."""
    return mixing.shuffled(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each drawn document."""
    return sharding.assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("quality classifier", drop_poor),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier and the shingle sets have no SQL form; tests hold run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's folder is deleted when the next one is written; the last one's stays, as the result reads it.
    """
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            remove(spark, f"{home}/{k - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that Spark wrote, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
