"""The engine's standard fixture over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first line), abstract, update_date of every document, also of those without a date."""
    # titles are cut before the join, so that whole texts meet the dates only where they are asked for
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"))
    o = table(spark, sf_dir, "orders")
    rows = d.join(o, d.doc_id == o.o_orderkey, "left")
    return rows.select("doc_id", "title", "abstract", F.date_format("o_orderdate", "yyyy-MM-dd").alias("update_date"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a vector and a date, with year, embedding and cluster_id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("cluster_id"))
    return dated(spark, sf_dir).where("update_date is not null").withColumn("year", F.substring("update_date", 1, 4).cast("int")).join(e, "doc_id")
