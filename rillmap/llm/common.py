"""Helpers shared by the corpus operators: shared-folder checkpoints, byte views of Arrow text, hashing, components."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; only where none is named and all is one machine, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages neither recompute `df` nor depend on the executor that made it."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession, rounds: int = 3) -> None:
    """Let Spark's cleaner delete shuffle files of plans that a checkpoint has replaced and nothing refers to."""
    for k in range(rounds):  # what holds on to a shuffle is itself collected a moment after the first round
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5 if k + 1 < rounds else 0)


def whole_row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns (but maps, which Spark does not hash): an order among rows of one id and text."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets start at 0."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows [lo, hi) of about `limit` bytes at most, whole texts; a longer text comes alone."""
    data, offsets = byte_view(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}
_letters = mix(np.arange(1, 257, dtype=np.uint64) * MULT)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Substrings:
    """Hashes of any substrings of one byte array, from one pass of prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data))
        with np.errstate(over="ignore"):
            terms = _letters[data] * up[: len(data)]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * MULT)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) by alternating star contraction: rows (node, root), root the smallest node.

    Each round is a partially aggregated minimum and an equi-join, checkpointed to the shared folder; no link or
    component reaches the driver, which sees one checksum a round. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def checksum(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    seen = checksum(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = materialize(small.where("a <> b").distinct())
        now = checksum(links)
        if now == seen:
            break
        seen = now
        release(spark, 1)
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
