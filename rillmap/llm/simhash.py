"""SimHash near-duplicates: exact Hamming-radius components by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, SPACE, Substrings, components, local_components, materialize, mix, release, text_blocks, whole_row_hash

SEED = 42
#: A block of a candidate table above this many fingerprints is split by further equal bits.
REFINE_ABOVE = 4096
#: Fingerprints that one comparison takes together, whole blocks.
BATCH = 2048


def _fingerprint(text: str | None, width: int) -> int:
    words = text.encode().lower().translate(_AS_SPACE).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    grams, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for lo in range(0, grams, 65536):  # a text's shingles are never held all at once
        part = np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(lo, min(grams, lo + 65536))], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > grams).tobytes(), "big")


_AS_SPACE = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): signed 64-bit SimHash of the whole text's word shingles; a null or wordless text has 0."""

    def compute(batches):
        for batch in batches:
            values = [_fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, "doc_id long, fp long")


def close_pairs(fps: np.ndarray, radius: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of close_parts at once."""
    parts = list(zip(*close_parts(fps, radius, block), strict=True))
    none = np.zeros(0, np.int64)
    return (np.concatenate(parts[0]), np.concatenate(parts[1])) if parts else (none, none)


#: Pairs that one step of a comparison looks at, and may find.
STEP_PAIRS = 1 << 20


def close_parts(fps: np.ndarray, radius: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints within `radius` bits, in parts of STEP_PAIRS at most; a fingerprint is a 64-bit number or a row of bytes.

    The fingerprints are transposed to bit planes, 64 fingerprints to a machine word. For a block of queries,
    each plane's differing bits are added to vertical counters by carry-save steps (and, xor); a counter that passes
    the radius sets its overflow bit for good, and a block of words stops when, at every sixteenth of the planes, each
    of its bits has overflowed.
    """
    n, levels = len(fps), max(1, int(radius + 1).bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    raw = fps if fps.ndim == 2 else fps.astype(">u8").view(np.uint8).reshape(n, 8)
    bits = np.unpackbits(raw, axis=1)
    width = bits.shape[1]
    order = np.argsort(np.abs(bits.mean(0) - 0.5), kind="stable") if n else np.arange(width)  # the most telling planes first
    for lo in range(0, n, block):
        part = bits[lo : lo + block]
        padded = np.zeros((-(-len(part) // 64) * 64, width), np.uint8)
        padded[: len(part)] = part
        planes = np.packbits(padded.T.copy(), axis=1).view(">u8").astype(np.uint64)
        tail = np.zeros(planes.shape[1], np.uint64)
        for k in range(len(part), len(padded)):
            tail[k // 64] |= np.uint64(1) << np.uint64(63 - k % 64)
        step = max(1, min(1 << 18, STEP_PAIRS // 64) // planes.shape[1])
        for q0 in range(0, min(n, lo + len(part)), step):
            mine = bits[q0 : min(q0 + step, lo + len(part))]
            over = np.broadcast_to(tail, (len(mine), len(tail))).copy()
            live = np.arange(len(mine))
            counters = [np.zeros_like(over) for _ in range(levels)]
            for done, p in enumerate(order, 1):
                carry = planes[p][None, :] ^ np.where(mine[live, p], full, np.uint64(0))[:, None]
                for c in counters:
                    c ^= carry
                    carry &= ~c
                over[live] |= carry
                if done % (width // 16) == 0:
                    past = over[live] | _exceeds(counters, radius)
                    over[live] = past
                    keep = (past != full).any(1)
                    if not keep.all():
                        live, counters = live[keep], [c[keep] for c in counters]
                    if not len(live):
                        break
            if not len(live):
                continue
            hit = np.unpackbits((~over[live]).astype(">u8").view(np.uint8).reshape(len(live), -1), axis=1)
            q, j = np.nonzero(hit)
            a, b = live[q] + q0, j + lo
            keep = a < b
            yield a[keep], b[keep]


def _united(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n nodes over pairs that come in parts: none is kept."""
    label = np.arange(n)
    for a, b in parts:
        a, b = label[a], label[b]
        apart = a != b
        if apart.any():
            ends = np.unique(np.minimum(a[apart], b[apart]) * n + np.maximum(a[apart], b[apart]))
            label = local_components(n, ends // n, ends % n)[label]
            if not label.any():  # all are one
                break
    return label


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose vertical counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above = above | (equal & counters[level])
            equal = equal & ~counters[level]
    return above


def _part(fp: str, cuts: list[int], i: int) -> str:
    return f"(shiftrightunsigned({fp}, {cuts[i]}) & {(1 << (cuts[i + 1] - cuts[i])) - 1}L)"


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """A spanning set of links (a, b) between distinct fingerprints `fp` at `radius` or fewer differing bits.

    Of radius + 2 bit groups at least two agree, so fingerprints meet in a table for each pair of groups. A block
    above REFINE_ABOVE rows is split by the same argument on its other bits (radius + 1 parts, one agrees),
    so no block is dropped or capped. In a block only the links to a component's root are returned.
    """
    groups = radius + 2
    cuts = [round(64 * i / groups) for i in range(groups + 1)]
    tables = list(combinations(range(groups), 2))

    def compare(batches):
        held, last = [np.zeros(0, np.int64)], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [*np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]
            if last != place[0]:
                cuts = [0, *cuts]
            lo = 0
            for at in cuts:  # a block begins here
                held.append(fp[lo:at])
                lo = at
                if at < len(place) and sum(map(len, held)) >= BATCH:
                    yield found(np.concatenate(held))
                    held = []
            last = place[-1]
        if held:
            yield found(np.concatenate(held))

    def found(values: np.ndarray) -> pa.RecordBatch:
        # A batch holds whole blocks; pairs that it finds between two blocks are links as well.
        values = np.unique(values)
        a, b = close_pairs(values.view(np.uint64), radius)
        root = local_components(len(values), a, b)
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pa.record_batch([values[moved], values[root[moved]]], ["a", "b"])

    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("t"), F.expr(f"{_part('fp', cuts, i)} * {1 << 32}L + {_part('fp', cuts, j)}").alias("key"))
        for k, (i, j) in enumerate(tables)
    ])).alias("x")).select("x.*", "fp")
    keyed = materialize(keyed)
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    small = keyed.join(sizes.where(F.col("n") <= REFINE_ABOVE), ["t", "key"], "left_semi").withColumn("fine", F.lit(0).cast("long"))
    hot = keyed.join(sizes.where(F.col("n") > REFINE_ABOVE), ["t", "key"], "left_semi")
    pieces = []
    for k, (i, j) in enumerate(tables):
        rest = [b for g in range(groups) if g not in (i, j) for b in range(cuts[g], cuts[g + 1])]
        for q in range(radius + 1):
            own = rest[len(rest) * q // (radius + 1) : len(rest) * (q + 1) // (radius + 1)]
            value = " | ".join(f"shiftleft(shiftrightunsigned(fp, {b}) & 1L, {n})" for n, b in enumerate(own)) or "0L"
            pieces.append(F.when(F.col("t") == k, F.expr(f"({value}) * 16L + {q + 1}L")))
    per = radius + 1
    refined = hot.withColumn("fine", F.explode(F.array(*[F.coalesce(*[pieces[k * per + q] for k in range(len(tables))]) for q in range(per)]))).select("t", "key", "fp", "fine")
    blocks = small.select("t", "key", "fp", "fine").union(refined)
    place = F.xxhash64("t", "key", "fine").alias("place")
    return blocks.select(place, "fp").repartition("place").sortWithinPartitions("place").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each input row.

    Equal fingerprints (hot for copies and for empty texts, which have fingerprint 0) are one node before any
    comparison. component_id is the smallest doc_id reachable; a null doc_id never becomes one unless a component
    has no other. Repeated rows each get a row. Extra columns of the input are ignored. An empty table gives none.
    """
    signed = materialize(fingerprints(docs, id_col, text_col, width))
    nodes = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits of the wide fingerprint, 64 from each of 16 hashes of a shingle: so many estimate a similarity to about 0.03.
WIDE = 1024
#: Hash orders in which rows may meet.
ORDERS = 8
#: Rows of a block that one task compares; a larger block is split by length, then into pairs of tiles.
TILE = 8192
#: Shingles of a block whose sets one task compares.
HELD = 1 << 22
_SALTS = mix(np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LOWER = np.array([k + 32 if 65 <= k <= 90 else k for k in range(256)], np.uint8)


@cache
def sure_radius(similarity: float, most: int = 64) -> int:
    """Differing bits of WIDE that no two sets of this Jaccard similarity or more exceed but by six standard deviations.

    A bit is a strict majority, so in small sets ties make it differ oftener than in large ones (4 of 5 shingles:
    0.19, the limit for large sets at 0.8: 0.15). The exact share is taken for all sizes up to `most`, the limit above.
    """
    worst = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    chance = [np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n for n in range(most + 1)]
    for small in range(1, most + 1):
        for large in range(small, most + 1):
            both = int(np.ceil(similarity * (small + large) / (1 + similarity) - 1e-9))
            if both > small:
                break
            shared = np.arange(both + 1)
            ones = [np.array([chance[n - both][2 * (k + np.arange(n - both + 1)) > n].sum() for k in shared]) for n in (small, large)]
            worst = max(worst, float((chance[both] * (ones[0] * (1 - ones[1]) + ones[1] * (1 - ones[0]))).sum()))
    return int(WIDE * worst + 6 * np.sqrt(WIDE * worst * (1 - worst)))


def _shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, hashes): of each text of a block its number of distinct shingles, and their hashes one text after another."""
    n = len(off) - 1
    data = _LOWER[data]
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(off, start, "right") - 1
    word = Substrings(data).hash(start, end)
    words = np.bincount(owner, minlength=n)
    place = np.arange(len(word)) - (np.cumsum(words) - words)[owner]
    at = np.flatnonzero(place < np.maximum(words - width + 1, 1)[owner])
    owner = owner[at]
    long_ = np.minimum(words, width)[owner]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            more = k < long_
            h[more] = h[more] * MULT + word[at[more] + k]
        h = mix(h + long_.astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=n), h[new]


def _sketch(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a block: distinct shingles, wide fingerprint (bytes), and the least values of ORDERS hashes."""
    n = len(off) - 1
    count, h = _shingles(data, off, width)
    prints, least = np.zeros((n, WIDE // 8), np.uint8), np.zeros((n, ORDERS), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return count, prints, least
    begin = (np.cumsum(count) - count)[some]
    chunks = -(-count[some] // 255)  # bits are counted in bytes, so in at most 255 rows together
    at_chunk = np.cumsum(chunks) - chunks
    chunk = np.repeat(begin - 255 * at_chunk, chunks) + 255 * np.arange(chunks.sum())
    stop = np.append(chunk[1:], len(h))
    ones = np.zeros((len(chunk), WIDE), np.uint8)
    hashes = np.empty((len(h), len(_SALTS)), np.uint64)
    for k, salt in enumerate(_SALTS):
        hashes[:, k] = mix(h ^ salt)
        if k < ORDERS:
            least[some, k] = np.minimum.reduceat(hashes[:, k], begin)
    for lo in range(0, len(chunk), 64):
        hi = min(lo + 64, len(chunk))
        part = hashes[chunk[lo] : stop[hi - 1]]
        bits = np.unpackbits(part.view(np.uint8), axis=1).view(np.uint64)
        ones[lo:hi] = np.add.reduceat(bits, chunk[lo:hi] - chunk[lo], axis=0).view(np.uint8)
    total = np.add.reduceat(ones, at_chunk, axis=0, dtype=np.int64)
    prints[some] = np.packbits(2 * total > count[some, None], axis=1)
    return count, prints, least


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, u, shingles, fp, least): of each row a hash of its text, its number of distinct word shingles, the
    WIDE-bit SimHash of that set, and the set's least element in 8 hash orders. Narrow."""

    def compute(batches):
        for batch in batches:
            count, prints, least = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, WIDE // 8), np.uint8), np.zeros((batch.num_rows, ORDERS), np.uint64)
            for lo, hi, data, off in text_blocks(batch.column(2), 1 << 20):
                count[lo:hi], prints[lo:hi], least[lo:hi] = _sketch(data, off, width)
            fp = pa.Array.from_buffers(pa.binary(WIDE // 8), batch.num_rows, [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary())
            flat = pa.ListArray.from_arrays(np.arange(0, least.size + 1, least.shape[1], dtype=np.int32), pa.array(least.ravel().view(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(count), fp, flat], ["doc_id", "u", "shingles", "fp", "least"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("u"), text.alias("text")).mapInArrow(compute, "doc_id long, u long, shingles long, fp binary, least array<long>")


def _deal(met: DataFrame, similarity: float, *held: str) -> DataFrame:
    """Rows (place, node, *held) of met (place, node, shingles, weight, *held), so that a task's blocks are bounded.

    A block above TILE rows or HELD weight is split by number of shingles, each row in its own band and the next
    (sizes whose ratio is below the similarity need not meet), and a band above them into tiles, each pair of which
    is compared in its own task: no block is dropped or capped, and none grows in one task.
    """
    share = F.greatest(F.count("*") / F.lit(float(TILE)), F.sum("weight") / F.lit(float(HELD)))
    sizes = met.groupBy("place").agg(F.count("*").alias("n"), share.alias("share")).where("n > 1").select("place", "share")
    sized = met.join(sizes, "place")
    small = sized.where("share <= 1").select("place", "node", *held)
    band = F.floor(F.log(F.greatest("shingles", F.lit(1)).cast("double")) / F.lit(float(-np.log(similarity)))).cast("long")
    hot = sized.where("share > 1").withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("place", "band").alias("place"), "node", "weight", *held)
    tiles = hot.groupBy("place").agg(F.ceil(share).cast("long").alias("tiles"))
    dealt = hot.join(tiles, "place").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    return small.union(dealt.select(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "node", *held))


def _compare(batches, found):
    """found(rows) over whole blocks, BATCH rows or HELD / 4 bytes and more together; pairs found between two of them count as well."""
    held, place, size, heavy = [], None, 0, 0
    for batch in batches:
        spot = batch.column(0).to_numpy()
        cuts = [0, *np.flatnonzero(spot[1:] != spot[:-1]) + 1, len(spot)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if spot[lo] != place and (size >= BATCH or heavy >= HELD // 4):
                yield found(pa.Table.from_batches(held))
                held, size, heavy = [], 0, 0
            place = spot[lo]
            held.append(batch.slice(lo, hi - lo))
            size += hi - lo
            heavy += held[-1].get_total_buffer_size() * (hi - lo) // batch.num_rows
    if held:
        yield found(pa.Table.from_batches(held))


def _moved(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(root != np.arange(len(node)))
    return pa.record_batch([node[moved], node[root[moved]]], ["a", "b"])


def _prints(rows: pa.Table, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint8).reshape(-1, WIDE // 8)[at]


def _similar(sets: list[np.ndarray], parts: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Smallest index reachable from each set over those pairs whose exact Jaccard similarity is `similarity` or more.

    Pairs come in parts, of which none is kept; pairs of sets that are linked already are not counted again.
    """
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    known, flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    mark = np.zeros(len(known), bool)
    for a, b in parts:
        least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        open_ = (label[a] != label[b]) & (least > 0) & (least >= similarity * most - 1e-9)
        a, b = a[open_], b[open_]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            one, others = a[lo], b[lo:hi]
            own = flat[begin[one] : begin[one + 1]]
            mark[own] = True
            for k in range(0, len(others), 512):
                some = others[k : k + 512]
                some = some[label[some] != label[one]]
                if not len(some):
                    continue
                step = size[some]
                head = np.cumsum(step) - step
                both = np.add.reduceat(mark[flat[np.repeat(begin[some] - head, step) + np.arange(step.sum())]], head, dtype=np.int64)
                near = some[both >= similarity * (size[one] + step - both) - 1e-9]
                if len(near):
                    joined = np.unique(label[np.append(near, one)])
                    label[np.isin(label, joined)] = joined[0]
            mark[own] = False
    return label


def rough_links(nodes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) that span every pair at `similarity` and pairs below it: a filter, by sketches only.

    `nodes` are rows (node, shingles, fp, least), one for each distinct sketch. Sets of similarity s share their least
    element in an order with probability s, so rows meet in blocks of equal least elements, 8 orders in all: a pair at
    0.8 meets nowhere once in 390000. There the bit-sliced comparison links rows within sure_radius bits.
    """
    radius = sure_radius(similarity)

    def found(rows: pa.Table) -> pa.RecordBatch:
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        return _moved(node, _united(len(node), close_parts(_prints(rows, at), radius)))

    keyed = nodes.select("node", F.posexplode("least").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"]).join(nodes.select("node", "shingles", "fp"), "node")
    met = materialize(met.select(F.xxhash64("t", "key").alias("place"), "node", "shingles", F.lit(0).cast("long").alias("weight"), "fp"))
    return _deal(met, similarity, "fp").repartition("place").sortWithinPartitions("place").mapInArrow(lambda x: _compare(x, found), "a long, b long")


def _keyed(id_col: str = "doc_id", hash_col: str = "u") -> list:
    """Columns that know a row's id and text by plain equalities, so that groups and joins on them share one shuffle."""
    return [F.col(id_col).isNull().alias("__no"), F.coalesce(F.col(id_col), F.lit(0).cast("long")).alias("__at"), F.col(hash_col).alias("__u")]


def copy_links(nodes: DataFrame, docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """A spanning set of links (a, b) between nodes whose shingle sets have a Jaccard similarity of `similarity` or more.

    `nodes` are rows (node, shingles, fp, least, best), `docs` rows (doc_id, u, text). Members of a component of
    rough_links meet, in a component above TILE rows those of equal least elements; pairs within sure_radius bits are
    counted on the sets themselves (64-bit hashes of the shingles), made again from one text of each such node. Where
    they meet is settled on narrow rows first, so that a text is dealt once by its id and once to where it is compared.
    """
    radius = sure_radius(similarity)

    def found(rows: pa.Table) -> pa.RecordBatch:
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        sets: list[np.ndarray] = []
        for _, _, data, off in text_blocks(rows.column("text").take(pa.array(at)).combine_chunks(), 1 << 20):
            count, h = _shingles(data, off, width)
            sets += np.split(h, np.cumsum(count)[:-1])
        return _moved(node, _similar(sets, close_parts(_prints(rows, at), radius), similarity))

    rough = components(rough_links(nodes, similarity))
    rough = materialize(rough.union(rough.select(F.col("root").alias("node"), "root")).distinct())
    sizes = rough.groupBy("root").agg(F.count("*").alias("n"))
    members = rough.join(sizes, "root").join(nodes.select("node", "shingles", "least"), "node")
    apart = members.where(F.col("n") > TILE).select("node", "shingles", "root", F.posexplode("least").alias("t", "key"))
    spots = members.where(F.col("n") <= TILE).select("node", "shingles", F.xxhash64("root").alias("place")).union(apart.select("node", "shingles", F.xxhash64("root", "t", "key").alias("place")))
    dealt = _deal(materialize(spots.select("place", "node", "shingles", F.col("shingles").alias("weight"))), similarity)
    wanted = dealt.groupBy("node").agg(F.collect_set("place").alias("places")).join(nodes.select("node", "fp", F.col("best.doc_id").alias("doc_id"), F.col("best.u").alias("u")), "node")
    wanted = materialize(wanted.select("node", "places", "fp", *_keyed()))
    release(docs.sparkSession)
    texts = docs.select(*_keyed(), "text").groupBy("__no", "__at", "__u").agg(F.first("text").alias("text"))
    met = texts.join(wanted, ["__no", "__at", "__u"]).select(F.explode("places").alias("place"), "node", "fp", "text")
    return met.repartition("place").sortWithinPartitions("place").mapInArrow(lambda x: _compare(x, found), "a long, b long")


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, u, component_id, kept), one for each input row: its text's hash, its group and whether it stays.

    Texts are sets of `width`-word shingles, A-Z in lower case (a shorter text is one shingle), and link where their
    Jaccard similarity is `similarity` or more, counted exactly; sketches only choose the pairs. Texts with equal
    sketches are one node, known by a 64-bit hash, before any comparison; null texts and texts without words are
    copies of each other. component_id is the group's smallest doc_id, null only where
    all are null. Kept are the rows of one (doc_id, text) in each group, that of the smallest doc_id and then hash.
    Extra columns are ignored. An empty table gives no rows.
    """
    rows = materialize(sketches(docs, id_col, text_col, width).withColumn("node", F.xxhash64("fp", "least", "shingles")))
    nodes = rows.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("fp").alias("fp"), F.first("least").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "u")).alias("best"))
    nodes = materialize(nodes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = components(copy_links(nodes, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("u"), text.alias("text")), similarity, width))
    rooted = nodes.join(found, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("best").alias("top")), "root").select("node", "top")
    return rows.join(named, "node").select("doc_id", "u", F.col("top.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("u") == F.col("top.u"))).alias("kept"))


def drop_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, one for each group of near_copies.

    Of rows with the id and text of the one that stays, that with the least hash of all its columns stays.
    """
    stay = near_copies(docs, similarity, width, id_col, text_col).where("kept").select(*_keyed()).distinct()
    release(docs.sparkSession)
    own = docs.withColumns({"__hash": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "__id": F.col(id_col).cast("long"), "__order": whole_row_hash(docs)})
    kept = own.select(*docs.columns, "__order", *_keyed("__id", "__hash")).join(stay, ["__no", "__at", "__u"], "left_semi")
    return kept.withColumn("__nth", F.expr("row_number() over (partition by __no, __at, __u order by __order)")).where("__nth = 1").select(*docs.columns)
