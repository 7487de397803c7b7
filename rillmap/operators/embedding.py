"""Embeddings by a pluggable encoder, with a resumable keyed checkpoint."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.functions.text import clean_words, pick_embed_text
from rillmap.sources.bucketed import BucketedTable


class Encoder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """The offline default: signed feature hashing of words and word pairs, scaled to length one."""

    def __init__(self, width: int = 384):
        self.width, self.name = width, f"hashing-{width}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for k, text in enumerate(texts):
            words = text.split()
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % self.width] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def embed(df: DataFrame, encoder: Encoder | None = None, checkpoint: str | None = None, key: str = "doc_id", stop_words: Sequence[str] = (), batch_size: int = 512) -> DataFrame:
    """`df` with an array<float> column `embedding` of its first text column, cleaned.

    With `checkpoint`, a folder of buckets keyed by (key, hash of model and cleaned text): rows already there are
    never encoded again, new ones are appended, and a changed text or model never meets an old vector. The history is
    read in its buckets: a resume deals the rows it is given, and of the table only what it adds. With a
    checkpoint a row without a key gets no vector.
    """
    encoder = encoder or HashingEncoder()
    rows = df.withColumn("__clean", clean_words(pick_embed_text(df), stop_words))

    def encode(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                part = batch.slice(lo, batch_size)
                vectors = encoder.encode(part.column(2).to_pylist()).astype(np.float32)
                flat = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, vectors.shape[1] if len(vectors) else 1, dtype=np.int32), pa.array(vectors.ravel()))
                yield pa.record_batch([part.column(0), part.column(1), flat], ["k", "h", "embedding"])

    todo = rows.select(F.col(key).alias("k"), F.sha2(F.concat_ws("\u0001", F.lit(encoder.name), "__clean"), 256).alias("h"), "__clean").distinct()
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, h string, embedding array<float>"
    if checkpoint is None:
        done = todo.mapInArrow(encode, schema)
    else:
        table = BucketedTable(df.sparkSession, checkpoint, schema)
        table.append(table.missing(todo).mapInArrow(encode, schema))
        done = table.read()
    done = done.select(F.col("k").alias("__k"), F.col("h").alias("__d"), "embedding")
    rows = rows.withColumn("__h", F.sha2(F.concat_ws("\u0001", F.lit(encoder.name), "__clean"), 256)).drop("embedding")
    same = F.col(key).eqNullSafe(F.col("__k")) if checkpoint is None else F.col(key) == F.col("__k")
    return rows.join(done, same & BucketedTable.same(F.col("__h"), F.col("__d")), "left").select(*[c for c in df.columns if c != "embedding"], "embedding")
