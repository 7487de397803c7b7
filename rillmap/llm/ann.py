"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, signed
from .embedding_dedup import matrix, usable

#: Fitting: sampled rows, sampled queries, and the share of their true neighbours that the probes must reach.
SAMPLE, TRIALS, AIM = 20000, 128, 0.96
#: Probes of a table; where they do not reach AIM on the sample, every query is answered exactly.
MOST_PROBES = 4096
#: Vectors of a table that one task should hold; queries that it should compare with all vectors of a block.
GROUP, QUERIES = 16384, 4096


class Tables:
    """Hash tables over vectors made unit by one more component, so that nearest means largest inner product.

    Vectors are hashed by bands of their norms, which double from one to the next, each on its own scale: one long vector does not
    make the others look alike. A query probes in every band.

    Each table has `hashes` functions floor((a.x + b) / w) with Gaussian a. A query's probes follow the order of
    estimated success: the squared distances of its projections to the perturbed sides, with one precomputed
    sequence of perturbation sets over their ranks.
    """

    def __init__(self, width: int, norm: float, bands: list[int], tables: int, hashes: int, w: float, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.norm, self.bands, self.tables, self.hashes, self.w = norm, bands, tables, hashes, w
        self.a = rng.standard_normal((tables, width + 1, hashes))
        self.b = rng.random((tables, hashes)) * w
        self.mult = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.probes, self.exact, self.visited = 1, False, 0.0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.column_stack([x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300), np.zeros(len(x))])
        x = x / (self.norm * np.exp2(-band_of(x, self.norm)))[:, None]
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def codes(self, lifted: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashed bucket, place within the slots) for table t."""
        y = (lifted @ self.a[t] + self.b[t]) / self.w
        slot = np.floor(y)
        with np.errstate(over="ignore"):
            return (slot.astype(np.int64).view(np.uint64) * self.mult[t]).sum(1, dtype=np.uint64), y - slot

    def sequence(self, most: int) -> np.ndarray:
        """Perturbation sets over the 2m ranked sides (most x 2m, zeros and ones), likeliest first by expected distance."""
        m = self.hashes
        j = np.arange(1, 2 * m + 1)
        z = np.where(j <= m, j * (j + 1) / (4.0 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4.0 * (m + 1) * (m + 2)))
        out, heap = [np.zeros(2 * m, np.uint64)], [(z[0], (0,))]
        while heap and len(out) < most:
            cost, s = heapq.heappop(heap)
            last = s[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (cost + z[last + 1] - z[last], (*s[:-1], last + 1)))
                heapq.heappush(heap, (cost + z[last + 1], (*s, last + 1)))
            if all(2 * m - 1 - k not in s for k in s):
                row = np.zeros(2 * m, np.uint64)
                row[list(s)] = 1
                out.append(row)
        return np.array(out)

    def probe_codes(self, lifted: np.ndarray, t: int, sequence: np.ndarray) -> np.ndarray:
        """Hashed buckets (queries x probes) in the order of estimated success."""
        home, place = self.codes(lifted, t)
        sides = np.column_stack([place, 1 - place])  # down, up
        m = self.hashes
        order = np.argsort(sides, axis=1, kind="stable")
        with np.errstate(over="ignore"):
            step = np.concatenate([np.uint64(0) - self.mult[t], self.mult[t]])[order]
            out = np.empty((len(lifted), len(sequence)), np.uint64)
            for lo in range(0, len(lifted), 256):
                out[lo : lo + 256] = home[lo : lo + 256, None] + step[lo : lo + 256] @ sequence.T
        return out


def band_of(x: np.ndarray, norm: float) -> np.ndarray:
    """How many times each vector's norm can be doubled without passing the largest norm."""
    return np.maximum(np.floor(np.log2(norm / np.sqrt((x * x).sum(1)))), 0).astype(np.int64)


def banded(code: np.ndarray, band) -> np.ndarray:
    """Buckets of a band: those of different bands do not meet."""
    with np.errstate(over="ignore"):
        return code + np.asarray(band, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fit(sample: np.ndarray, total: int, k: int, norm: float, bands: list[int]) -> Tables:
    """Tables for `total` vectors: hashes by log of their number, probes by the sampled queries' recall.

    `exact` says that MOST_PROBES do not reach AIM, `visited` which share of the sample the probes visit.
    """
    many = 4
    hashes = int(np.clip(round(np.log2(max(total, 64)) * 0.62), 3, 16))
    tables = Tables(sample.shape[1], norm, bands, many, hashes, 2.4)
    queries = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    true = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    sequence = tables.sequence(MOST_PROBES)
    data, asked = tables.lift(sample, False), tables.lift(queries, True)
    rank = np.full(true.shape, len(sequence))
    for t in range(many):
        own, _ = tables.codes(data, t)
        probes = tables.probe_codes(asked, t, sequence)
        for q in range(len(queries)):
            order = np.argsort(probes[q], kind="stable")
            at = np.minimum(np.searchsorted(probes[q][order], own[true[q]]), len(order) - 1)
            rank[q] = np.minimum(rank[q], np.where(probes[q][order[at]] == own[true[q]], order[at], len(sequence)))
    reached = np.sort(rank.ravel())
    need = reached[min(len(reached) - 1, int(np.ceil(AIM * len(reached))))] if len(reached) else 0
    tables.exact = bool(need >= len(sequence))
    tables.probes = int(min(len(sequence), need + 1))
    seen = np.zeros((len(queries), len(sample)), bool)
    for t in range(many):
        own, _ = tables.codes(data, t)
        probes = tables.probe_codes(asked, t, sequence[: tables.probes])
        for q in range(len(queries)):
            seen[q] |= np.isin(own, probes[q])
    tables.visited = float(seen.mean()) if seen.size else 0.0
    return tables


def _best(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray, rough: np.ndarray | None, k: int, repeated: bool):
    """The k best ids of the candidates `at`, each by its best vector, the query's own left out first.

    Rough scores choose rows of enough different ids, one fixed double-precision sum decides, ties go to the smaller id.
    `repeated`: an id may have several vectors here.
    """
    at = at[ids[at] != own]
    most = 3 * k + 24
    if len(at) > most:
        rough = x[at] @ query if rough is None else rough[at]
        if repeated:
            order = np.argsort(-rough, kind="stable")
            first = np.sort(np.unique(ids[at][order], return_index=True)[1])  # where each id's best row stands
            at = at[order[: first[most] if len(first) > most else len(order)]]
        else:
            at = at[np.argpartition(-rough, most - 1)[:most]]
    score = (x[at] * query).sum(1)
    order = np.lexsort((ids[at], -score))
    if repeated:
        order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
    return ids[at][order[:k]], score[order[:k]]


_FOUND = "query_id long, ids array<long>, scores array<double>"


def _table(out: list[tuple]) -> pa.Table:
    return pa.table({
        "query_id": pa.array([o[0] for o in out], pa.int64()),
        "ids": pa.array([o[1] for o in out], pa.list_(pa.int64())),
        "scores": pa.array([o[2] for o in out], pa.list_(pa.float64())),
    })


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k largest inner products found, itself (its id) left out.

    All vectors are indexed. The index is fitted on a bounded sample: SAMPLE rows and TRIALS queries choose the
    number of probes whose recall is AIM. A table's buckets are dealt to groups of about GROUP vectors; a query goes
    once to each group in which it probes, with its probed buckets, and each task returns k candidates for it,
    exactly scored on the original vectors in double precision; the tables' candidates merge. Queries for which fewer
    than k were found, and all of them where MOST_PROBES do not reach AIM, are compared with all vectors, in pairs of
    blocks. Of equal vectors only the k + 1 smallest ids can ever be among the nearest, and only those are indexed.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors without an
    id or of another width than most of the sample. Ties go to the smaller id. Rows that repeat an id and vector
    count once; an id with several vectors is as near as its nearest one, and as a query it asks with each. Extra columns are ignored; an empty table gives
    no rows, and fewer than k candidates give as many rows.
    """
    spark = vectors.sparkSession
    clean = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    # repeated rows first, partly aggregated; then WindowGroupLimit cuts a frequent vector's ids before they are shuffled
    distinct = clean(vectors).distinct().withColumn("same", F.expr("row_number() over (partition by v order by id)")).where(f"same <= {k + 1}").select("id", "v")
    data = materialize(distinct)
    sample = data.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow().column("v").to_pylist()
    if not sample:
        return spark.createDataFrame([], schema)
    widths = [len(v) for v in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    data = data.where(F.size("v") == width)
    length = F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + double(x) * double(x)))")
    total, others, norm = data.agg(F.count("*"), F.countDistinct("id"), F.max(length)).first()
    down = F.log2(F.lit(norm) / length)  # both bands of a norm that lies between two, as norms are summed in another order elsewhere
    near = data.select(F.explode(F.array(F.floor(down - 1e-9), F.floor(down + 1e-9))).alias("band")).distinct().collect()  # a row for each power of two
    tables = fit(np.array([v for v in sample if len(v) == width], float), total, k, norm, sorted({max(0, r.band) for r in near}))
    groups = max(1, -(-total // GROUP))
    shared = spark.sparkContext.broadcast(tables)
    kind = data.schema["v"].dataType.simpleString()
    layout = f"t int, g int, id long, v {kind}, codes array<long>"

    def place(batches):
        tables = shared.value
        for batch in batches:
            x = matrix(batch.column(1))
            lifted, band = tables.lift(x, False), band_of(x, tables.norm)
            for t in range(tables.tables):
                code = banded(tables.codes(lifted, t)[0], band)
                lists = pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32), pa.array(signed(code.copy())))
                yield pa.record_batch([np.full(len(code), t, np.int32), (mix(code) % np.uint64(groups)).astype(np.int32), batch.column(0), batch.column(1), lists], names)

    def ask(batches):
        tables = shared.value
        sequence = tables.sequence(tables.probes)
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            lifted = tables.lift(matrix(batch.column(1)), True)
            for t in range(tables.tables):
                base = tables.probe_codes(lifted, t, sequence)
                codes = np.concatenate([banded(base, b) for b in tables.bands], axis=1)
                spot = np.repeat(np.arange(len(codes)), codes.shape[1]) * groups + (mix(codes) % np.uint64(groups)).astype(np.int64).ravel()
                order = np.argsort(spot, kind="stable")
                spot = spot[order]
                heads = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
                lists = pa.ListArray.from_arrays(np.append(heads, len(spot)).astype(np.int32), pa.array(signed(codes.ravel()[order])))
                some = batch.take(pa.array(spot[heads] // groups))
                yield pa.record_batch([np.full(len(heads), t, np.int32), (spot[heads] % groups).astype(np.int32), some.column(0), some.column(1), lists], names)

    names = ["t", "g", "id", "v", "codes"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = left.column("id").to_numpy(), matrix(left.column("v").combine_chunks())
            repeated = len(np.unique(ids)) < len(ids)
            code = left.column("codes").combine_chunks().flatten().to_numpy()
            order = np.argsort(code, kind="stable")
            ids, x, code = ids[order], x[order], code[order]
            heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            sizes, kinds = np.diff(np.append(heads, len(code))), code[heads]
            probes = right.column("codes").combine_chunks()
            flat, edges = probes.flatten().to_numpy(), probes.offsets.to_numpy()
            edges = edges - edges[0]
            query_ids, queries = right.column("id").to_numpy(), matrix(right.column("v").combine_chunks())
            at = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
            hit = kinds[at] == flat
            visits = np.concatenate([[0], np.cumsum(np.where(hit, sizes[at], 0))])[edges]
            for lo in range(0, len(queries), 64):
                hi = min(lo + 64, len(queries))
                # one product where most rows are visited anyway, else the visited rows alone
                rough = queries[lo:hi] @ x.T if 8 * (visits[hi] - visits[lo]) > (hi - lo) * len(x) else None
                for q in range(lo, hi):
                    found = at[edges[q] : edges[q + 1]][hit[edges[q] : edges[q + 1]]]
                    if not len(found):
                        continue
                    size = sizes[found]
                    rows = np.repeat(heads[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    out.append((int(query_ids[q]), *_best(queries[q], query_ids[q], ids, x, rows, None if rough is None else rough[q - lo], k, repeated)))
        return _table(out)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = left.column("id").to_numpy(), matrix(left.column("v").combine_chunks())
            repeated = len(np.unique(ids)) < len(ids)
            query_ids, queries = right.column("id").to_numpy(), matrix(right.column("v").combine_chunks())
            for lo in range(0, len(queries), 64):
                rough = queries[lo : lo + 64] @ x.T
                out += [(int(query_ids[lo + q]), *_best(queries[lo + q], query_ids[lo + q], ids, x, np.arange(len(x)), r, k, repeated)) for q, r in enumerate(rough)]
        return _table(out)

    def merge(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks().flatten().to_numpy()
        score = table.column("scores").combine_chunks().flatten().to_numpy()
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:k]
        n = len(first)
        return pa.table({"query_id": pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array(ids[first], pa.int64()), "score": pa.array(score[first], pa.float64())})

    asking = clean(queries).where(F.size("v") == width).distinct()
    short, done = asking, None
    if not tables.exact:
        found = data.mapInArrow(place, layout).groupBy("t", "g").cogroup(asking.mapInArrow(ask, layout).groupBy("t", "g")).applyInArrow(search, _FOUND)
        done = materialize(found.groupBy("query_id").applyInArrow(merge, schema))
        # what is found of fewer than k others is whole only if it is all of them
        enough = done.groupBy("query_id").count().where(F.col("count") >= min(k, others)).select(F.col("query_id").alias("id"))
        short = materialize(asking.join(enough, "id", "left_anti"))
        if short.isEmpty():
            return done
    spans = max(1, -(-short.count() // QUERIES))
    dealt = data.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("long").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("s"), "id", "v")
    asked = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(spans)).cast("int").alias("s"), "id", "v")
    exact = dealt.groupBy("g", "s").cogroup(asked.groupBy("g", "s")).applyInArrow(compare, _FOUND).groupBy("query_id").applyInArrow(merge, schema)
    return exact if done is None else done.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(exact)
