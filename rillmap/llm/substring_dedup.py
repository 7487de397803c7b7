"""Exact substring deduplication by suffix arrays with two-stage sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Substrings, byte_view, materialize, mix, release, signed, text_blocks

GRAM = 20
#: An anchor with more distinct contexts than this is split by window offset and by what those windows share.
HOT = 16384
CHUNK = 8
NULL_ID = -(1 << 63)
#: Bits of a packed place: the first window's byte, windows, anchor's distance; then two marks. Texts under one id are told
#: apart by all 64 bits of their hash u, and come in the order of its low TAG bits, then of the rest.
TAG, START, COUNT, SPOT, GONE, HOT_MARK = 0x7FFFFF, 0xFFFFFFFF, 32, 40, 1 << 61, 1 << 62


def _by_text(doc: np.ndarray, u: np.ndarray, start: np.ndarray, *above: np.ndarray) -> np.ndarray:
    """Order by the keys `above` (the last first), then by place: id, text and byte."""
    return np.lexsort((start, u, u & TAG, doc, *above))


def _elsewhere(lead: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a row stands at another place than its group's first."""
    return np.logical_or.reduce([x != x[lead] for x in place])


def _find_contexts(data: np.ndarray, off: np.ndarray, length: int):
    """Runs of `length`-byte windows with one minimiser: (anchor hash, document, first window, windows, anchor place).


    Equal windows have the same minimiser (the leftmost least hash of their GRAM-byte strings) at the same place.
    """
    starts, ends = off[:-1], off[1:]
    spread = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if not (ends - starts >= length).any():
        return none.astype(np.uint64), none, none, none, none, None
    sub = Substrings(data)
    n = len(data)
    at = np.arange(n - GRAM + 1)
    grams = sub.hash(at, at + GRAM)
    low = (grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    have = 1
    while have < spread:
        step = min(have, spread - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    where = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= ends[doc]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new), len(where))
    stop = stop[np.searchsorted(stop, begin, "right")]
    last_valid = ends[doc[begin]] - length + 1
    count = np.minimum(stop, last_valid) - begin
    return grams[where[begin]], doc[begin], begin, count, where[begin], sub


def _windows(batches, length: int):
    """First pass: in each block the first occurrence of every context goes on, later ones are removals at once."""
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, off in text_blocks(batch.column(2), 2 << 20):
            for base, data, off in _segments(data, off, length):
                anchor, doc, begin, count, spot, sub = _find_contexts(data, off, length)
                if not len(doc):
                    continue
                context = sub.hash(begin, begin + count + length - 1)
                doc_id, u = ids[lo:hi][doc], hashes[lo:hi][doc]
                start = begin - off[doc] + base
                order = _by_text(doc_id, u, start, context, anchor)
                a, c, d, h, p = anchor[order], context[order], doc_id[order], u[order], start[order]
                first = np.ones(len(a), bool)
                first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                lead = np.flatnonzero(first)[np.cumsum(first) - 1]
                gone = _elsewhere(lead, d, h, p)
                keep = first | gone
                packed = p | ((count | ((spot - begin) << (SPOT - COUNT)))[order] << COUNT) | gone * GONE
                # a removal needs neither its anchor nor its context: it is dealt by its place
                key, c = np.where(gone, mix(mix(h.view(np.uint64) ^ d.view(np.uint64)) + p.astype(np.uint64)), a), np.where(gone, np.uint64(0), c)
                yield pa.record_batch([signed(key[keep].copy()), signed(c[keep].copy()), d[keep], h[keep], packed[keep]], ["key", "context", "doc_id", "u", "place"])


def _segments(data: np.ndarray, off: np.ndarray, length: int, most: int = 12 << 20):
    """Blocks as they are up to `most` bytes; a longer text (alone in its block) in stretches that overlap by length - 1 bytes."""
    if len(data) <= most:
        yield 0, data, off
        return
    for at in range(0, len(data) - length + 1, most):
        part = data[at : at + most + length - 1]
        yield at, part, np.array([0, len(part)], np.int64)


def _by_key(batches, column: int):
    """Batches of a sorted partition regrouped so that no key is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut == 0 and held and held[-1].column(column)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else None
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _collapse(batches, hot: int = HOT, most: int = 1 << 16):
    """Second pass, over rows sorted by anchor and context: later copies of a context are removals; of anchors with
    several contexts the first occurrences go on to be sorted.

    Held are some `most` rows, and of the anchor that is open the first occurrence of each context until they are more
    than `hot`, then that of the open context alone: an anchor may be of any size.
    """
    names = ["anchor", "doc_id", "u", "place"]
    carry, crowded = [np.zeros(0, np.int64)] * 5, None

    def settle(parts, last: bool):
        nonlocal carry, crowded
        a, c, d, u, p = (np.concatenate(x) for x in zip(carry, *parts, strict=True))
        carry = [np.zeros(0, np.int64)] * 5
        over = (p & GONE) > 0
        if over.any():
            yield pa.record_batch([np.zeros(int(over.sum()), np.int64), d[over], u[over], p[over]], names)
        a, c, d, u, p = (x[~over] for x in (a, c, d, u, p))
        if not len(a):
            return
        order = _by_text(d, u, p & START, c, a)
        a, c, d, u, p = a[order], c[order], d[order], u[order], p[order]
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        first = new_a.copy()
        first[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(first)
        lead = at[np.cumsum(first) - 1]
        gone = _elsewhere(lead, d, u, p & START)
        group = np.cumsum(new_a) - 1
        kinds = np.bincount(group, weights=first)
        if a[0] == crowded:
            kinds[0] += hot
        many = kinds[group]
        held = np.zeros(len(a), bool)
        if not last:
            crowded = a[-1] if many[-1] > hot else None
            if crowded is None:
                held = first & (group == group[-1])
            else:
                held[at[-1]] = True
            carry = [x[held] for x in (a, c, d, u, p)]
        keep = gone | (first & (many > 1) & ~held)
        p = p | gone * GONE | (many > hot) * HOT_MARK
        yield pa.record_batch([np.where(gone, 0, a)[keep], d[keep], u[keep], p[keep]], names)

    parts, size = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append([batch.column(k).to_numpy() for k in range(5)])
            size += batch.num_rows
        if size >= most:
            yield from settle(parts, False)
            parts, size = [], 0
    yield from settle(parts, True)


def _fetch(batches, length: int):
    """Third pass, over texts joined with their wanted contexts: the contexts' bytes, keyed by anchor.

    A hot anchor's contexts are cut by the windows' distance to the anchor, CHUNK windows to a piece, and keyed by
    the bytes that the chunk's windows share: equal windows meet, and the hot group falls apart.
    """
    spread = length - GRAM + 1
    for batch in batches:
        wanted = batch.column(3)
        edges = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        flat = wanted.flatten()
        anchor, packed = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        place, hot = packed & START, (packed & HOT_MARK) > 0
        data, off = byte_view(batch.column(2))
        row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
        ids, us = (batch.column(k).to_numpy()[row] for k in range(2))
        at = off[row] + place
        n, spot = packed >> COUNT & 0xFF, packed >> SPOT & 0xFF
        raw = data.tobytes()
        calm = np.flatnonzero(~hot)
        keys, docs, hashes, places, counts = (x[calm] for x in (anchor, ids, us, place, n))
        pieces = [raw[b:e] for b, e in zip(at[calm].tolist(), (at + n + length - 1)[calm].tolist(), strict=True)]
        extra: list[tuple] = []
        for k in np.flatnonzero(hot):
            r0 = spread - 1 - int(spot[k])  # of the first window; the windows end with r = spread - 1
            zero, count = int(at[k]) - r0, int(n[k])
            for c in range(r0 // CHUNK, (r0 + count - 1) // CHUNK + 1):
                lo, hi = max(r0, c * CHUNK), min(r0 + count, (c + 1) * CHUNK)
                core = raw[zero + (c + 1) * CHUNK - 1 : zero + c * CHUNK + length]
                key = hashlib.blake2b(core, digest_size=8, salt=b"%d" % c).digest()
                extra.append((int.from_bytes(key, "little", signed=True), int(ids[k]), int(us[k]), int(place[k]) + lo - r0, hi - lo, raw[zero + lo : zero + hi + length - 1]))
        if extra:
            cols = list(zip(*extra, strict=True))
            keys, docs, hashes, places, counts = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((keys, docs, hashes, places, counts), cols, strict=False))
            pieces += cols[5]
        for lo in range(0, len(pieces), 20000):
            part = slice(lo, lo + 20000)
            yield pa.record_batch([keys[part], docs[part], hashes[part], places[part] | counts[part] << COUNT, pa.array(pieces[part], pa.binary())], ["anchor", "doc_id", "u", "place", "bytes"])


def _words(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4 and 8 bytes from every position on as big-endian numbers, zeros past the end."""
    x = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    two = (x[:-1] << np.uint64(8)) | x[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    return four[: len(t)], eight[: len(t)]


def two_stage_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in the order of their first `depth` bytes or more.

    Suffixes smaller than their successor are sorted directly, eight bytes a round, ties only. One scan over the
    first-byte buckets in ascending order induces the others: where suffix i stands, i - 1 goes to the end of the
    larger part's list of its bucket. The scan takes a bucket at a time, its own additions in further rounds.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(t.astype(np.int16), append=-1))
    known = np.where(step != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[nearest] > 0
    direct = np.flatnonzero(smaller)
    _, eight = _words(t)
    eight = np.concatenate([eight, np.zeros(depth + 8, np.uint64)])
    group = np.zeros(len(direct), np.int64)
    settled = np.zeros(len(direct), np.int64)
    active, at = direct, 0
    places = np.arange(len(direct))
    while len(active) and at < depth:
        key = eight[active + at]
        order = np.lexsort((key, group)) if at else np.argsort(key, kind="stable")
        active, key, group = active[order], key[order], group[order]
        settled[places] = active
        fresh = np.ones(len(active), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(fresh) - 1
        tied = (np.bincount(group) > 1)[group]
        active, places, group = active[tied], places[tied], group[tied]
        at += 8
    heads = np.searchsorted(t[settled], np.arange(257)) if len(settled) else np.zeros(257, np.int64)
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, own: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = t[before]
        if not len(before):
            return before
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        mine = before[:0]
        for part in np.split(before, cuts):
            c = int(t[part[0]])
            lists[c].append(part)
            if c == own:
                mine = part
        return mine

    lists[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        if lists[c]:
            larger = np.concatenate(lists[c])
            while len(larger):
                out.append(larger)
                larger = induce(larger, c)
        own = settled[heads[c] : heads[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def _later_windows(doc: np.ndarray, u: np.ndarray, place: np.ndarray, count: np.ndarray, texts: list[bytes], length: int):
    """Windows of these contexts that also start earlier, as runs (doc_id, u, place, windows)."""
    sizes = count + length - 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(1)  # the separator 0xff, in no UTF-8 text, becomes 0
    order = two_stage_order(joined, length)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)[order]
    windows = order - begin[owner] < count[owner]
    order, owner = order[windows], owner[windows]
    four, eight = _words(joined)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = eight[order[live] + at] == eight[order[live + 1] + at]
    group = np.concatenate([[0], np.cumsum(~same)])
    d, h, p = doc[owner], u[owner], place[owner] + order - begin[owner]
    rank = _by_text(d, h, p, group)
    g, d, h, p = group[rank], d[rank], h[rank], p[rank]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    gone = _elsewhere(lead, d, h, p)
    d, h, p = d[gone], h[gone], p[gone]
    rank = _by_text(d, h, p)
    d, h, p = d[rank], h[rank], p[rank]
    start = np.ones(len(d), bool)
    start[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (p[1:] > p[:-1] + 1)
    at = np.flatnonzero(start)
    last = np.append(at[1:], len(d)) - 1
    return d[at], h[at], p[at], (p[last] - p[at] + 1) if len(at) else p[at]


def _sort_contexts(batches, length: int, most: int = 1 << 20):
    """Fourth pass: suffix arrays over runs of about `most` bytes of contexts, whole anchors."""
    for table in _by_key(batches, 0):
        if table is None or not table.num_rows:
            continue
        anchor, doc, u, place = (table.column(k).to_numpy() for k in range(4))
        place, count = place & START, place >> COUNT & 0xFF
        texts = table.column(4).to_pylist()
        ends = np.cumsum(count + length)
        last = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        lo = 0
        while lo < len(anchor):
            base = ends[lo - 1] if lo else 0
            fits = last[(last > lo) & (ends[last - 1] - base <= most)]
            hi = int(fits[-1]) if len(fits) else int(last[last > lo][0])
            d, h, p, n = _later_windows(doc[lo:hi], u[lo:hi], place[lo:hi], count[lo:hi], texts[lo:hi], length)
            if len(d):
                yield pa.record_batch([d, h, p, n.astype(np.int64)], ["doc_id", "u", "start", "n"])
            lo = hi


def _cut(batches, length: int, with_text: bool):
    """Last pass: the kept bytes of each text."""
    for batch in batches:
        data, off = byte_view(batch.column(1))
        raw = data.tobytes()
        out: list[tuple] = []
        for k, (doc_id, nth, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            text, size = raw[off[k] : off[k + 1]], int(off[k + 1] - off[k])
            merged: list[list[int]] = []
            if nth > 1:
                merged = [[0, size]] if size >= length else []
            elif spans:
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
            bounds = [0, *(x for m in merged for x in m), size]
            kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            row = (doc_id, size, size - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
            out.append((*row, merged, kept) if with_text else row)
        if out:
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()], strict=False)]
            yield pa.record_batch(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: len(arrays)])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each input row; with_text adds removed, kept.

    Removed is every byte covered by a `length`-byte string that also starts earlier: at a smaller doc_id, or before
    in the same text. Every window of `length` bytes belongs to the context of its minimiser, so equal windows meet
    under one key whatever documents hold them, in pieces a window long: nothing is replicated between documents.
    Copies of a whole context are settled by hash, first in each block and then for each anchor; of anchors with
    different contexts the bytes are fetched, their suffixes sorted in two stages, and adjacent common prefixes of
    `length` bytes or more compared by place. Nulls are empty texts. Rows with one doc_id and different texts are
    told apart and ordered by the texts' 64-bit hash (its low 23 bits first); of repeated rows the first keeps what one row would, the rest are later copies. A
    null doc_id comes before all others. Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("u"), "text")
    found = base.where(F.octet_length("text") >= length).mapInArrow(lambda x: _windows(x, length), "key long, context long, doc_id long, u long, place long")
    dealt = found.repartition("key").sortWithinPartitions("key", "context")
    settled = materialize(dealt.mapInArrow(lambda x, how=_collapse.__defaults__: _collapse(x, *how), "anchor long, doc_id long, u long, place long"))
    release(spark)
    gone = F.col("place").bitwiseAND(F.lit(GONE)) != 0
    wanted = settled.where(~gone).groupBy("doc_id", "u").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))
    contexts = base.join(wanted, ["doc_id", "u"]).select("doc_id", "u", "text", "wanted").mapInArrow(lambda x: _fetch(x, length), "anchor long, doc_id long, u long, place long, bytes binary")
    sorted_ = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda x: _sort_contexts(x, length), "doc_id long, u long, start long, n long")
    later = settled.where(gone).select("doc_id", "u", F.expr(f"place & {START}L").alias("start"), F.expr(f"(place >> {COUNT}) & 255L").alias("n")).union(sorted_)
    spans = later.groupBy("doc_id", "u").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + length - 1).alias("end"))).alias("spans"))
    spans = materialize(spans)
    release(spark)
    numbered = base.withColumn("nth", F.expr("row_number() over (partition by doc_id, u order by doc_id)"))
    joined = numbered.join(spans, ["doc_id", "u"], "left").select("doc_id", "text", "nth", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", removed array<array<long>>, kept binary" if with_text else "")
    out = joined.mapInArrow(lambda x: _cut(x, length, with_text), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
