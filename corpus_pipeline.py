"""A training corpus from raw documents: quality, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmap.llm.common import shared_checkpoints
from rillmap.llm.mixing import mix
from rillmap.llm.packing import pack
from rillmap.llm.quality import keep_good
from rillmap.llm.queries import table, tokenizer_path
from rillmap.llm.secrets import redact
from rillmap.llm.simhash import drop_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go; it learns as in op6.

    Null and empty texts are scored as empty texts; repeated rows share their fate. Where the labels know one class or
    none, all go or stay by it (0.5 without labels: all go). Rows without an id are scored but never learned from. Other
    columns are carried along, whatever their names; an empty table gives none.
    """
    labels = table(spark, sf_dir, "labels").where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    return keep_good(docs, labels.select("doc_id", F.col("quality").alias("label")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose sets of five-word shingles have a similarity of 0.8 or more.

    That is the one with the smallest id, then the least hash of its text, then of its whole row; rows without an id
    stay only where their group has no other. Null texts and texts without words are one group.
    """
    return drop_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by a mark; n_chars follows the new text.

    Null texts stay null and keep their n_chars; repeated rows change alike; a text of any length is scanned whole.
    """
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: none, once or twice.

    Null texts and texts without words are never taken. A null source is one of its own; where a group of repeated rows
    is taken in part, it does not matter which, and of rows with other columns those of the least hash are taken.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, or of a smaller power of two; null and empty texts are an end token each."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: The stages train models, compare fingerprints and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again by the next.

    A stage's folder goes once the next stage has been written; the last one's stays, for the result is read from it.
    """
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
