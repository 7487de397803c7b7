"""Hierarchical packing of tokenised documents into training sequences of several context sizes."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Characters over which the splitting of texts into words is the same in every Unicode version.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")
#: Fixed value: the words of a byte-level tokenizer (contractions, letters, numbers, other marks, white space).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A longer text is encoded in slices of about so many characters, cut at a single space, where a new word begins.
SLICE = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_state: dict[str, object] = {}


class _Encoder:
    """Ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit numbers.

    A file of byte-level BPE whose merges are numbered in their order is a table of ranks: tiktoken's merging over
    it gives the ids that the tokenizer gives, several times faster. A text with a special token's string or with
    characters that the two might split differently goes to the tokenizer itself, and so do all texts where the file
    asks for anything else.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(json.loads(Path(path).read_text(encoding="utf-8")), set(self.special))

    @staticmethod
    def _ranked(file: dict, special: set[str]):
        """The merger for a plain byte-level BPE file, else None."""
        split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
        plain = {k: split.get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain &= model.get("type") == "BPE" and not any(file.get(k) for k in ("normalizer", "truncation", "padding"))
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        try:
            from tiktoken import _tiktoken
        except ImportError:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(vocab.get(m) != 256 + k for k, m in enumerate(merged)) or any(vocab.get(c, 256) > 255 for c in letter):
            return None
        return _tiktoken.CoreBPE({bytes(letter[c] for c in w): vocab[w] for w in [*letter, *merged] if w not in special}, {}, _SPLIT)

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * SLICE and (cut := _CUT.search(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.ranked is None or _OTHER.search(text) or any(s in text for s in self.special):
            return self._plain(text)
        try:
            return b"".join(bytes(self.ranked.encode_to_tiktoken_buffer(part, set())) for part in self.slices(text))
        except ValueError:  # white space by the million is more than its pattern takes
            return self._plain(text)


def encoder(path: str) -> _Encoder:
    if path not in _state:
        _state[path] = _Encoder(path)
    return _state[path]


def tier_sizes(window: int, smallest: int) -> list[int]:
    """Context sizes, longest first: the window and its halves, down to `smallest` or so."""
    sizes = [window]
    while sizes[-1] % 2 == 0 and sizes[-1] // 2 >= smallest:
        sizes.append(sizes[-1] // 2)
    return sizes


def plan(lengths: list[int], window: int, smallest: int) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """((size, pieces) of full sequences, pieces left over) for some documents; a piece is (document, start, length).

    Whole windows are cut off long documents. What is left of each is routed to the tier of the smallest context size
    that holds it, and every tier is packed into sequences of its own size, the longest first: its longest piece
    opens one, and the gap takes the longest piece that fits, from its own tier or a shorter one, then the head of
    the shortest piece, whose tail goes to the tier of its length. So all sequences are full; the pieces of the only
    one that is not are left over, shorter than a window together.
    """
    sizes = tier_sizes(window, smallest)
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting: list[tuple[int, int, int]] = []  # by length, so each tier is a stretch of it
    for d, n in enumerate(lengths):
        whole = n // window * window
        done += [(window, [(d, at, window)]) for at in range(0, whole, window)]
        if n > whole:
            waiting.append((n - whole, d, whole))
    waiting.sort()
    for size, below in zip(sizes, [*sizes[1:], 0], strict=True):
        while waiting and waiting[-1][0] > below:
            n, d, at = waiting.pop()
            pieces, gap = [(d, at, n)], size - n
            while gap and waiting:
                k = bisect_right(waiting, (gap, 1 << 62, 0)) - 1
                if k >= 0:
                    m, e, start = waiting.pop(k)
                    pieces.append((e, start, m))
                    gap -= m
                else:
                    m, e, start = waiting.pop(0)
                    pieces.append((e, start, gap))
                    insort(waiting, (m - gap, e, start + gap))
                    gap = 0
            if gap:  # nothing waits any more
                return done, pieces
            done.append((size, pieces))
    return done, []


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_SEQUENCE = f"whole boolean, size int, cost double, pieces array<struct<{_PIECE.replace(' ', ': ').replace(',:', ',')}>>"
_KIND = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))


def _packed(docs: list[tuple[int | None, int, int, bytes]], window: int, smallest: int, with_ids: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Sequences of the documents (doc_id, first id's place, doc_tokens, ids); with `last` also of what is left over."""
    docs.sort(key=lambda x: (x[0] is None, x[0], x[2], x[1], zlib.crc32(x[3])))
    full, rest = plan([len(x[3]) // 4 for x in docs], window, smallest)
    rows = [(True, s, p) for s, p in full] + ([(last, window, rest)] if rest else [])
    for lo in range(0, len(rows), 4096):
        part = rows[lo : lo + 4096]
        out = []
        for whole, _, pieces in part:
            made = []
            for d, start, length in pieces:
                doc_id, first, tokens, ids = docs[d]
                own = ids[4 * start : 4 * (start + length)]
                made.append((doc_id, first + start, length, zlib.crc32(own), tokens, own if with_ids or not whole else None))
            out.append(made)
        columns = list(zip(*(p for made in out for p in made), strict=True))
        struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND.value_type, strict=True)], names=[f.name for f in _KIND.value_type])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(m) for m in out])]), pa.int32()), struct)
        cost = [float(sum(p[2] ** 2 for p in pieces)) for _, _, pieces in part]
        yield pa.record_batch([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array(cost), lists], ["whole", "size", "cost", "pieces"])


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, smallest: int = 256, end_id: int = 1, block_tokens: int = 1 << 22, per_group: int = 64, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows, one for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Texts are tokenised and packed (`plan`) where they are read, `block_tokens` at a time, so that no text is dealt
    and no task holds more than a block and one document; a document ends with `end_id`. What a block leaves over,
    less than a window, is packed again with what the others left, in blocks of the same bound, each of which leaves
    one sequence unfilled at most. `tier` is a sequence's context size: sequences are full, the unfilled ones alone
    are to be padded to the window. Sequences are then ranked by cost (the sum of their pieces' squared lengths) in
    one range sort over narrow rows, numbered by rank, and dealt to and fro to step groups of `per_group` at most,
    so that all groups cost about the same.

    Null and empty texts are documents of the end token alone; repeated rows are packed each for itself; a null
    doc_id is carried along; a very long text is encoded in slices that meet at a space (as a whole where it has
    none). With `with_ids` the pieces' ids come too. Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")

    def tokenized(batches):
        model = encoder(tokenizer)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = model.encode(text.as_py() or "") + end
                yield doc_id.as_py(), 0, len(ids) // 4, ids

    def left_over(batches):
        for batch in batches:
            for pieces in batch.column(0).to_pylist():
                yield from ((p["doc_id"], p["start"], p["doc_tokens"], p["ids"]) for p in pieces)

    def packer(read, last):
        def compute(batches):
            held, tokens = [], 0
            for doc in read(batches):
                held.append(doc)
                tokens += len(doc[3]) // 4
                if tokens >= block_tokens:
                    yield from _packed(held, window, smallest, with_ids, last)
                    held, tokens = [], 0
            if held:
                yield from _packed(held, window, smallest, with_ids, last)

        return compute

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(rows.mapInArrow(packer(tokenized, False), _SEQUENCE))
    rest = made.where("not whole")
    tokens = rest.agg(F.sum(F.expr("aggregate(pieces, 0L, (s, p) -> s + p.length)"))).first()[0] or 0
    again = rest.select("pieces").repartition(max(1, -(-tokens // block_tokens))).mapInArrow(packer(left_over, True), _SEQUENCE)
    sequences = made.where("whole").unionByName(again)
    dealt = sequences.repartitionByRange(F.desc("cost"), F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["start"]).sortWithinPartitions(F.desc("cost"), F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["start"])
    ranked = materialize(dealt.select(F.monotonically_increasing_id().alias("place"), F.col("size").alias("tier"), "pieces"))
    counts = ranked.groupBy(F.expr("place >> 33").alias("part")).count().orderBy("part").collect()  # a row for each partition
    heads = np.concatenate([[0], np.cumsum([r["count"] for r in counts])]).tolist()
    groups = max(1, -(-heads[-1] // per_group))
    small = spark.createDataFrame([(r.part, h) for r, h in zip(counts, heads, strict=False)], "part long, head long")
    numbered = ranked.join(F.broadcast(small), F.expr("place >> 33") == F.col("part")).withColumn("sequence_id", F.expr(f"head + (place & {(1 << 33) - 1}L)"))
    lap, seat = F.expr(f"sequence_id div {groups}"), F.expr(f"sequence_id % {groups}")
    numbered = numbered.withColumn("step_group", F.when(lap % 2 == 1, groups - 1 - seat).otherwise(seat))
    pieces = numbered.select("sequence_id", "tier", "step_group", "pieces", F.posexplode("pieces").alias("at", "p"))
    offset = F.expr("aggregate(slice(pieces, 1, at), 0L, (s, x) -> s + x.length)").alias("offset")
    return pieces.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", offset, "tier", "step_group", *(["p.ids"] if with_ids else []))
