"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: a worker holds a batch of whole texts, some of them very long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"))
    return identify(docs, docs.where("not held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Rows without an id are in no fold that is held out.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


def _split(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.expr(HELD_OUT))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    docs, labels = _split(table(spark, sf_dir, "documents")), _split(table(spark, sf_dir, "labels"))
    scored = score_quality(docs, labels.where("not held_out").select("doc_id", F.col("quality").alias("label")))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs, labels = _split(table(spark, sf_dir, "documents")), _split(table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, labels.where("not held_out").select("doc_id", F.col("toxic").alias("label")))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import audit

    tampered = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")
    return audit(table(spark, sf_dir, "documents"), tampered, {"text": F.expr("replace(text, '\n', '')")})


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_mix_sources, op2_substring_dedup, op3_nearest_neighbours, op4_language_id, op5_simhash, op6_quality, op7_packing, op8_embedding_dedup, op9_secret_scan, op10_toxicity, op11_merkle_manifest, op12_importance_resampling, op13_window_dedup, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
