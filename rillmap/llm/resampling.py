"""Importance resampling towards a target distribution of hashed n-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs, text_blocks
from .numbering import numbered

#: Bytes of text that a worker classifies at a time, whole texts.
BLOCK = 2 << 20
#: Words of more bytes than this are few: their CRC is taken by zlib, one by one.
LONG = 48
#: The CRC table of the reflected polynomial, by its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ np.where(_CRC & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The automaton's classes, after lower-casing: digits, a to z, and every byte of a character beyond ASCII are of words.
_OF_WORD = np.zeros(256, bool)
_OF_WORD[48:58] = _OF_WORD[97:123] = _OF_WORD[128:] = True


def find_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, word starts, word ends, words before each text) of texts laid end to end in `data`."""
    parted = np.insert(_LOWER[data], off[1:], 32)  # a space ends every text
    start, end = runs(_OF_WORD[parted])
    return parted, start, end, np.searchsorted(start, off + np.arange(len(off)))


def advance(crc: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Raw CRC-32 states moved over data[at : at + size], all starts a byte a step; the longest stand first and go on last."""
    short = np.minimum(size, LONG + 1).astype(np.int16)
    order = np.argsort(-short, kind="stable")
    out, place, lengths = crc[order], at[order], short[order]
    live = np.searchsorted(-lengths, -np.arange(LONG + 1), "left")  # live[k]: how many have more than k bytes
    far = int(live[LONG])
    for k in range(LONG):
        m = int(live[k])
        if m == far:
            break
        out[far:m] = _CRC[(out[far:m] ^ data[place[far:m] + k]) & np.uint32(255)] ^ (out[far:m] >> np.uint32(8))
    for i in range(far):
        lo = int(place[i])
        out[i] = zlib.crc32(data[lo : lo + int(size[order[i]])], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, off: np.ndarray, longest: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(CRC, first word) of all runs of 1, 2, .. `longest` words], words before each text)."""
    parted, start, end, heads = find_words(data, off)
    doc = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    first = np.arange(len(start))
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    found = []
    for n in range(longest):
        if n:
            same = first + n < len(doc)
            same[same] = doc[first[same] + n] == doc[first[same]]
            first, state = first[same], state[same]
            state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = advance(state, parted, start[first + n], (end - start)[first + n])
        found.append((state ^ np.uint32(0xFFFFFFFF), first))
    return found, heads


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> DataFrame:
    """(bucket, total): how many features fall in each bucket; each task adds up its own first."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, off in text_blocks(batch.column(0), BLOCK):
                for crc, _ in features(data, off, longest)[0]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([held, total[held]], ["bucket", "total"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10000, longest: int = 2) -> np.ndarray:
    """Of each bucket, floor(1000 ln) of the ratio of its smoothed shares in target and docs: a row a bucket on the driver."""
    spark = docs.sparkSession
    own, aim = (materialize(bucket_counts(x, buckets, longest)) for x in (docs, target))
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(own.withColumnRenamed("total", "s"), "bucket", "left").join(aim.withColumnRenamed("total", "t"), "bucket", "left").fillna(0)
    sums = [x.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] + buckets for x in (own, aim)]
    gain = F.expr(f"cast(floor(1000 * ln((t + 1D) * {sums[0]}D / ((s + 1D) * {sums[1]}D))) as long)")
    rows = every.select("bucket", gain.alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features; none: 0."""
    buckets = len(gain)

    def mean(batches):
        for batch in batches:
            out = []
            for _, _, data, off in text_blocks(batch.column(1), BLOCK):
                found, heads = features(data, off, longest)
                total, n = np.zeros(len(heads) - 1, np.int64), np.zeros(len(heads) - 1, np.int64)
                for crc, first in found:
                    cut = np.searchsorted(first, heads)
                    total += np.diff(np.concatenate([[0], np.cumsum(gain[crc % np.uint32(buckets)])])[cut])
                    n += np.diff(cut)
                out.append((np.diff(heads), n, total // np.maximum(n, 1)))
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mean, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10000, longest: int = 2, percent: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Words and the CRC-32 of every run of 1 to `longest` words come from the texts' UTF-8 bytes in Arrow buffers: a
    lookup table classifies bytes, differences of the classes bound the words, and the CRC table moves the states of
    all starts at once, a byte a step. A first pass counts features by bucket in `docs` and `target` (a row a bucket
    and task is dealt), a second averages each document's gains. Score is weight plus seeded Gumbel noise of the id;
    of the documents with at least `least` words, the `percent` with the highest scores are drawn, ties to the smaller
    id, and numbered in ranges over the cluster.

    Null and empty texts have no features and weight 0. A null id is hashed as an empty one and comes first among
    ties. Repeated rows are documents each. Texts are taken whole, however long: a worker holds some 40 bytes for each
    byte of a block or of one longer text. Without target texts all shares are smoothed alone. An empty table gives no rows.
    """
    scored = weigh(docs, gains(docs, target, buckets, longest), longest)
    h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as double)"
    scored = materialize(scored.withColumn("score", F.expr(f"weight + cast(floor(-1000 * ln(-ln(({h} + 0.5D) / 4294967296D))) as long)")))
    fit = F.col("n_words") >= least
    ranked = numbered(scored.where(fit), [], [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")])
    drawn = F.when(F.col("idx") < F.expr(f"({percent} * n) div 100"), F.col("idx") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, drawn.alias("rank")).unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
