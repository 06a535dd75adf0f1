"""From raw documents to sharded training data: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
mixing stage repeats documents: a document that the mix takes twice is two rows. Every stage takes null texts, ids and
sources, empty and very long texts, ties, repeated rows, no rows, and further columns of any name, and passes these on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, mixing, quality, shards, simhash
from lectern.llm.common import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of at least 0.5; each row by its own text, whole.

    Null and empty texts score the share of good labels. Without labels of both kinds everything stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows without an id come last.

    Null, empty and blank texts are copies of each other. Of rows equal in id and text one stays.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one of its own, null texts have no words.

    Rows that repeat, with or without an id, are drawn one by one.
    """
    return mixing.apply(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; rows without an id share one key."""
    return shards.plan(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", keep_one_copy),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", to_shards),
]

#: Compression and fingerprints can't be written in SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what passes between them is written to the shared folder and read again.

    What a stage has read is deleted when its own output is written, so only the last one's stays.
    """
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
