"""Deduplication of word windows: a sharded count-min sketch chooses the windows that are grouped exactly."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Substrings, byte_view, materialize, mix, release, runs, shared_checkpoints
from .common import _power_tables as power_tables
from .substring_dedup import _by_key as by_key

#: Bytes of text, whole documents, whose windows are asked about together.
BLOCK = 8 << 20
#: Counters of the sketch for each window, one from each hash.
SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D))
#: A shard of the sketch has at most 2**26 counters and asks for some 2**24 bytes; beyond 2**20, a table has 256 of them or more.
LEAST_SHARD, MOST_SHARD, SHARDS = 12, 26, 8
#: Windows of a shard of the exact grouping: about 2**21, whatever the size of the table.
EXACT = 23
NO_ID = (1 << 63) - 1
ESTIMATE, TEXTS = -1, 1 << 50
_ROW = "kind int, block long, slot long, n long, a binary, b binary, c binary, d binary, doc_id long, text string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4, pa.int64(), pa.string()]


class _Sequences(Substrings):
    """Hashes of any runs of a sequence of numbers, as Substrings has them of bytes."""

    def __init__(self, values: np.ndarray):
        up, self.down = power_tables(len(values))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])


class Windows:
    """The words of some texts and the 96-bit hashes of all windows of `width` words, none across two texts."""

    def __init__(self, column: pa.Array, width: int, hashed: bool = True):
        data, off = byte_view(column)
        self.data = np.insert(data, off[1:], 32)  # a space ends every text
        self.start, self.end = runs(~SPACE[self.data])
        self.heads = np.searchsorted(self.start, off + np.arange(len(off)))
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.heads))
        n = len(self.start)
        first = np.arange(max(0, n - width + 1))
        self.first = first[self.doc[: len(first)] == self.doc[width - 1 :]] if len(first) else first
        if hashed:
            words = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            lo = 0
            while lo < n:  # by stretches, so that a very long text needs no prefix sums of all its bytes
                hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + (4 << 20), "right")))
                at = self.start[lo]
                part = self.data[at : self.end[hi - 1]]
                for w, flip in zip(words, (0, 0xA5), strict=True):
                    w[lo:hi] = Substrings(part ^ np.uint8(flip)).hash(self.start[lo:hi] - at, self.end[lo:hi] - at)
                lo = hi
            self.h1 = _Sequences(words[0]).hash(self.first, self.first + width)
            self.h2 = (_Sequences(mix(words[1])).hash(self.first, self.first + width) >> np.uint64(32)).astype(np.uint32)

    def cells(self, row: int, bits: int):
        """(distinct cells in order, each window's place among them, windows in each) of one row of the sketch."""
        return np.unique(mix(self.h1 ^ SALTS[row]) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)

    def distinct(self, chosen: np.ndarray, ids: np.ndarray):
        """(h1, h2, least id) of the chosen windows that differ, in order, and each chosen window's place among them."""
        h1, h2, own = self.h1[chosen], self.h2[chosen], ids[self.doc[self.first[chosen]]]
        order = np.lexsort((own, h2, h1))
        h1, h2, own = h1[order], h2[order], own[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        place = np.empty(len(h1), np.int64)
        place[order] = np.cumsum(new) - 1
        return h1[new], h2[new], own[new], place


def pack_gaps(cells: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit gaps; a 65535 adds that much to the gap that follows."""
    gaps = np.diff(cells, prepend=0)
    far = gaps // 65535
    out = np.full(len(gaps) + int(far.sum()), 65535, "<u2")
    out[np.arange(len(gaps)) + np.cumsum(far)] = gaps % 65535
    return out.tobytes()


def unpack_gaps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, "<u2")
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, block, slot, n, a, b, c, d) without text."""
    columns = [*zip(*rows, strict=True), [None] * len(rows), [None] * len(rows)]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _groups(key: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal keys in order."""
    if not len(key):
        return []
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(cuts, cuts[1:], strict=False))


def _ask_sketch(batches, width: int, bits: int, shard: int):
    """First pass: texts gathered to blocks (kind 0), and each block's own sketch, by shards (kind 1).

    A block's sketch holds its cells that have a window and whether they have two; row r's shard s has slot r << 40 | s.
    """
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def settle():
        nonlocal made, held, size
        ids, texts = (pa.concat_arrays([h[k] for h in held]) for k in range(2))
        block, made, held, size = task << 33 | made, made + 1, [], 0
        n = len(ids)
        nothing = pa.nulls(n, pa.binary())
        yield pa.record_batch([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), pa.array(TEXTS + np.arange(n)), pa.nulls(n, pa.int64()), nothing, nothing, nothing, nothing, ids, texts], _NAMES)
        windows = Windows(texts, width)
        if not len(windows.first):
            return
        rows = []
        for r in range(len(SALTS)):
            cells, _, count = windows.cells(r, bits)
            which, inner = (cells >> np.uint64(shard)).astype(np.int64), (cells & np.uint64((1 << shard) - 1)).astype(np.int64)
            rows += [(1, block, r << 40 | int(which[lo]), hi - lo, pack_gaps(inner[lo:hi]), _bits(count[lo:hi] > 1), None, None) for lo, hi in _groups(which)]
        yield _record(rows)

    for batch in batches:
        texts = batch.column(1).fill_null("").cast(pa.string())
        lengths = np.diff(byte_view(texts)[1])
        lo = 0
        for hi in range(1, batch.num_rows + 1):
            size += int(lengths[hi - 1])
            if size >= BLOCK:
                held.append((batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo)))
                yield from settle()
                lo = hi
        if lo < batch.num_rows:
            held.append((batch.column(0).slice(lo), texts.slice(lo)))
    if held:
        yield from settle()


def _whole(batches, column: int) -> Iterator[pa.Table]:
    """The rows of one key after the other, from a partition sorted by that column."""
    for table in by_key(batches, column):
        if table is not None:
            for lo, hi in _groups(table.column(column).to_numpy()):
                yield table.slice(lo, hi - lo)


def _merge_sketch(batches, shard: int):
    """Second pass, a shard at a time: the blocks' sketches added up; each block learns which of its cells have two windows."""
    for rows in _whole(batches, 2):
        count = np.zeros(1 << shard, np.uint8)
        for cells, twice, n in zip(*(rows.column(k).to_pylist() for k in (4, 5, 3)), strict=True):
            at = unpack_gaps(cells)
            count[at] = np.minimum(2, count[at] + 1 + _unbits(twice, n))
        out = []
        for block, slot, n, cells in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
            out.append((0, block, slot, n, _bits(count[unpack_gaps(cells)] > 1), None, None, None))
            if len(out) == 500:
                yield _record(out)
                out = []
        if out:
            yield _record(out)


def _ask_exact(batches, width: int, bits: int, shards: int):
    """Third pass, a block's texts with the sketch's answers: windows that every row estimates repeated are asked for by hash."""
    for rows in _whole(batches, 1):
        block, slots = rows.column(1)[0].as_py(), rows.column(2).to_numpy()
        texts = int(np.searchsorted(slots, TEXTS))
        answers = list(zip(slots[:texts].tolist(), *(rows.column(k).slice(0, texts).to_pylist() for k in (3, 4)), strict=True))
        if not answers:
            continue
        ids = rows.column(8).slice(texts).fill_null(NO_ID).to_numpy()
        windows = Windows(rows.column(9).slice(texts).combine_chunks(), width)
        chosen = np.ones(len(windows.first), bool)
        for r in range(len(SALTS)):
            said = [_unbits(raw, n) for slot, n, raw in answers if slot >> 40 == r]
            chosen &= np.concatenate(said)[windows.cells(r, bits)[1]]
        if not chosen.any():
            continue
        out = [(1, block, ESTIMATE - block, len(chosen), _bits(chosen), None, None, None)]
        h1, h2, own, _ = windows.distinct(np.flatnonzero(chosen), ids)
        which = (h1 >> np.uint64(64 - shards)).astype(np.int64) if shards else np.zeros(len(h1), np.int64)
        for lo, hi in _groups(which):
            names, index = np.unique(own[lo:hi], return_inverse=True)
            out.append((2, block, int(which[lo]), hi - lo, h1[lo:hi].tobytes(), h2[lo:hi].tobytes(), index.astype("<u4" if len(names) > 65535 else "<u2").tobytes(), names.tobytes()))
        yield _record(out)


def _answer_exact(batches):
    """Fourth pass, a shard at a time: of each asked window whether a smaller id asks for it too."""
    for rows in _whole(batches, 2):
        if rows.column(0)[0].as_py() == 1:  # an estimate goes back to its block
            for batch in rows.to_batches():
                yield batch
            continue
        sizes = rows.column(3).to_numpy()
        h1, h2 = (np.frombuffer(b"".join(rows.column(k).to_pylist()), t) for k, t in ((4, np.uint64), (5, np.uint32)))
        own = []
        for index, names in zip(rows.column(6).to_pylist(), rows.column(7).to_pylist(), strict=True):
            names = np.frombuffer(names, np.int64)
            own.append(names[np.frombuffer(index, "<u4" if len(names) > 65535 else "<u2")])
        own = np.concatenate(own)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = np.minimum.reduceat(own[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = least < own[order]
        ends = np.cumsum(sizes)
        blocks, slots = rows.column(1).to_pylist(), rows.column(2).to_pylist()
        for lo in range(0, len(blocks), 500):
            yield _record([(2, blocks[k], slots[k], int(sizes[k]), _bits(later[ends[k] - sizes[k] : ends[k]]), None, None, None) for k in range(lo, min(len(blocks), lo + 500))])


def _cut(batches, width: int, with_text: bool):
    """Last pass, a block's texts with all answers: the words that no window removes."""
    for rows in _whole(batches, 1):
        slots = rows.column(2).to_numpy()
        texts = int(np.searchsorted(slots, TEXTS))
        answers = list(zip(slots[:texts].tolist(), *(rows.column(k).slice(0, texts).to_pylist() for k in (3, 4)), strict=True))
        doc_ids = rows.column(8).slice(texts).combine_chunks()
        ids = doc_ids.fill_null(NO_ID).to_numpy()
        windows = Windows(rows.column(9).slice(texts).combine_chunks(), width, bool(answers))
        kept = np.ones(len(windows.start), bool)
        if answers:
            chosen = np.flatnonzero(_unbits(answers[0][2], answers[0][1]))
            _, _, own, place = windows.distinct(chosen, ids)
            later = np.concatenate([_unbits(raw, n) for _, n, raw in answers[1:]])
            first = windows.first[chosen]
            first = first[later[place] | (own[place] < ids[windows.doc[first]])]
            edge = np.zeros(len(kept) + 1, np.int64)
            edge[first] += 1
            edge[first + width] -= 1
            kept = np.cumsum(edge)[:-1] == 0
        step = np.zeros(len(windows.data) + 2, np.int8)  # a kept word stays with the one byte behind it, which becomes a space
        step[windows.start[kept]] += 1
        step[windows.end[kept] + 1] -= 1
        data = windows.data.copy()
        data[windows.end] = 32
        mask = np.cumsum(step, dtype=np.int8)[:-2].astype(bool)
        data = data[mask].tobytes()
        length = np.concatenate([[0], np.cumsum((windows.end - windows.start + 1) * kept)])[windows.heads]
        n_words = np.diff(windows.heads)
        n_kept = np.diff(np.concatenate([[0], np.cumsum(kept)])[windows.heads])
        pieces = [data[lo : max(lo, hi - 1)] for lo, hi in zip(length.tolist(), length[1:].tolist(), strict=False)]
        columns = [doc_ids, pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
        if with_text:
            columns.append(pa.array([p.decode() for p in pieces], pa.string()))
        yield pa.record_batch(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])


def remove_repeated_windows(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bits: int | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each input row; with_text adds the kept words.

    Removed is every word covered by a window of `width` words that also starts in a document with a smaller doc_id;
    what a document repeats of itself stays. Texts are gathered to blocks as they are read, and each block sketches its
    windows: two rows of counters, of which only those that are not zero are kept. The sketch has a counter in each row for each
    byte of all texts, and so some five for each window at every size (or 2**bits); it is dealt by shards, where the
    blocks' sketches are merged, and no task holds more than a shard. A block gets back a bit for each of its cells.
    A window is estimated repeated where both rows say so, which is never too little: only those are dealt by hash (96 bits),
    once a block, and grouped exactly. All that grows with the corpus is dealt, nothing is broadcast.

    Null and empty texts have no words. Rows without an id count as one document after all others. Rows of one id never
    remove each other's words, so repeated rows fare alike. Extra columns are ignored. Texts are taken whole: a worker
    holds some 150 bytes for each word of a block or of one longer text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = bits or max(LEAST_SHARD, ceil(log2(size + 1)))
    shard, shards = max(min(LEAST_SHARD, bits), min(MOST_SHARD, bits - SHARDS)), max(0, bits - EXACT)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/windows-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda x: _ask_sketch(x, width, bits, shard), _ROW).write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    texts, asked = (_stored(spark, folder, kind) for kind in (0, 1))
    said = materialize(asked.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda x: _merge_sketch(x, shard), _ROW))
    _delete(spark, f"{folder}/kind=1")
    release(spark)
    met = texts.unionByName(said).repartition("block").sortWithinPartitions("block", "slot")
    wanted = met.mapInArrow(lambda x: _ask_exact(x, width, bits, shards), _ROW).repartition("slot").sortWithinPartitions("slot")
    said = materialize(wanted.mapInArrow(_answer_exact, _ROW))
    release(spark)
    met = texts.unionByName(said).repartition("block").sortWithinPartitions("block", "slot")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    out = materialize(met.mapInArrow(lambda x: _cut(x, width, with_text), schema))
    _delete(spark, folder)
    return out


def _stored(spark: SparkSession, folder: str, kind: int) -> DataFrame:
    """The rows of one kind, as no other's files are looked for; none where none were written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/kind={kind}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _ROW)
    return spark.read.schema(_ROW.partition(", ")[2]).parquet(str(path.toString())).select(F.lit(kind).cast("int").alias("kind"), *_NAMES[1:])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
