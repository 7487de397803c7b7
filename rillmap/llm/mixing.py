"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, whole_row_hash

BINS = 1024
#: Documents of a boundary bin that one task may order.
BIN_ROWS = 512


def share_out(sizes: Sequence[int], weights: Sequence[int], total: Fraction, most: Fraction) -> list[Fraction]:
    """Targets in proportion to the weights, none above `most` times its size; what is cut off is shared anew."""
    targets, open_ = [Fraction(0)] * len(sizes), [k for k in range(len(sizes))]
    left = Fraction(total)
    while open_ and (heavy := sum(weights[k] for k in open_)):
        unit = left / heavy
        full = [k for k in open_ if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in open_:
                targets[k] = unit * weights[k]
            break
        for k in full:
            targets[k] = most * sizes[k]
            left -= targets[k]
        open_ = [k for k in open_ if k not in set(full)]
    return targets


def route(capacity: Sequence[int], members: Sequence[Sequence[int]], demand: Sequence[int], repeats: int) -> list[dict[int, list[int]]]:
    """Min-cost flow from membership patterns to source quotas: per pattern, source -> tokens by repetition.

    A pattern's k-th repetition is an arc of its whole capacity at cost 2k - 1, so the cost is convex in the times
    its tokens are used, and the flow spreads use before it repeats. Successive shortest paths with potentials
    (Dijkstra), deterministic. Demand beyond what is reachable stays unmet.
    """
    n, m = len(capacity), len(demand)
    start, end = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        one, back = [b, room, cost, None], [a, 0, -cost, None]
        one[3], back[3] = back, one
        graph[a].append(one)
        graph[b].append(back)
        return one

    for p in range(n):
        for k in range(repeats):
            arc(start, p, capacity[p], 2 * k + 1)
    wanted = {(p, s): arc(p, n + s, repeats * capacity[p], 0) for p in range(n) for s in members[p]}
    for s in range(m):
        arc(n + s, end, demand[s], 0)
    price = [0] * len(graph)
    while True:
        far = [float("inf")] * len(graph)
        far[start], by, heap = 0, [None] * len(graph), [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                v, room, cost, _ = e
                if room > 0 and (new := d + cost + price[u] - price[v]) < far[v]:
                    far[v], by[v] = new, e
                    heapq.heappush(heap, (new, v))
        if by[end] is None:
            break
        price = [p + f if f < float("inf") else p for p, f in zip(price, far, strict=True)]
        path, v = [], end
        while v != start:
            path.append(by[v])
            v = by[v][3][0]
        flow = min(e[1] for e in path)
        for e in path:
            e[1] -= flow
            e[3][1] += flow
    out: list[dict[int, list[int]]] = []
    for p in range(n):
        used = {s: wanted[p, s][3][1] for s in members[p]}
        levels, filled, room = {}, 0, capacity[p]
        for s, x in used.items():  # a source's share of a pattern lies in one stretch of its repetitions
            levels[s] = [filled, filled + x]
            filled += x
        assert filled <= repeats * room
        out.append({s: v for s, v in levels.items() if v[1] > v[0]})
    return out


def _order(seed: int, id_col: str, text_col: str):
    """The seeded hash by which documents are chosen; equal for equal ids and texts."""
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def sized(docs: DataFrame, id_col: str, text_col: str, sources: str, seed: int) -> DataFrame:
    """Small rows for the plan: doc_id, pattern (sorted distinct sources), size in words, seeded order u."""
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(sources).alias("pattern"), size.alias("size"), _order(seed, id_col, text_col).alias("u"))


def _plan(rows: DataFrame, weights: Sequence[int], share: Fraction, repeats: int) -> tuple[DataFrame, DataFrame]:
    """(cut, picked). cut has a row for each pattern: base, low, high, gap, source_size, target, stretches.

    Documents of a pattern are taken `base` times and once more if u < low; from low to high, BIN_ROWS documents at
    most, `picked` (doc_id, u, n, picks) says how many of the n rows are. A stretch (source, from_lap, from_u, to_lap,
    to_u) says whose quota pays for lap k of the documents with (from_lap, from_u) <= (k, u) < (to_lap, to_u).
    """
    spark = rows.sparkSession
    patterns = [(tuple(r[0]) if r[0] is not None else (None,), int(r[1])) for r in rows.groupBy("pattern").agg(F.sum("size")).collect()]
    patterns.sort(key=lambda p: [(s is None, s or "") for s in p[0]])
    names = sorted({s for p in patterns for s in p[0]}, key=lambda s: (s is None, s or ""))
    at = {s: k for k, s in enumerate(names)}
    source_size = [sum(size for p, size in patterns if s in p) for s in names]
    total = sum(size for _, size in patterns) * share
    targets = share_out(source_size, [weights[k % len(weights)] for k in range(len(names))], total, Fraction(repeats))
    members = [sorted({at[s] for s in p}) for p, _ in patterns]
    flows = route([size for _, size in patterns], members, [round(t) for t in targets], repeats)
    # where a flow ends, and where one source's stretch of a pattern passes into the next's
    ends = {(p, e): divmod(e, size) for (p, size), f in zip(patterns, flows, strict=True) for _, e in f.values()}
    spots = _thresholds(rows, {k: gap for k, (_, gap) in ends.items() if gap})
    plan, floor = [], -(1 << 63)
    for k, ((p, _), f) in enumerate(zip(patterns, flows, strict=True)):
        wanted = max((e for _, e in f.values()), default=0)
        base, gap = ends.get((p, wanted), (0, 0))
        low, high, left = spots.get((p, wanted), (None, None, None)) if gap else (None, None, None)
        stretches, start = [], (0, floor)
        for s, (_, e) in sorted(f.items(), key=lambda x: x[1]):
            lap, part = ends[p, e]
            stop = (repeats, floor) if e == wanted else (lap, spots[p, e][0] if part and (p, e) in spots else floor)
            stretches.append((names[s], *start, *stop))
            start = stop
        own = members[k][0]
        plan.append((list(p), base, low, high, left, source_size[own], float(targets[own]), stretches))
    cut = spark.createDataFrame(plan, "p array<string>, base long, low long, high long, gap long, source_size long, target double, stretches array<struct<source: string, from_lap: long, from_u: long, to_lap: long, to_u: long>>")

    def fit(table: pa.Table) -> pa.Table:
        left = table.column("gap")[0].as_py()
        order = sorted(zip(*(table.column(c).to_pylist() for c in ("u", "doc_id", "size", "n")), strict=True), key=lambda x: (x[0], x[1] is None, x[1], x[2]))
        picks = []
        for _, _, size, n in order:
            picks.append(min(n, left // size))
            left -= size * picks[-1]
        return pa.table({"pd": pa.array([x[1] for x in order], pa.int64()), "pu": pa.array([x[0] for x in order], pa.int64()), "n": pa.array([x[3] for x in order], pa.int64()), "picks": pa.array(picks, pa.int64())})

    inside = rows.join(F.broadcast(cut), rows.pattern.eqNullSafe(cut.p)).where("u >= low and u <= high and size > 0")
    inside = inside.groupBy("pattern", "doc_id", "u", "size", "gap").agg(F.count("*").alias("n"))  # repeated rows are one
    return cut, materialize(inside.groupBy("pattern").applyInArrow(fit, "pd long, pu long, n long, picks long"))


def _thresholds(rows: DataFrame, todo: dict[tuple, int]) -> dict[tuple, tuple[int, int, int]]:
    """(low, high, gap) for each (pattern, place): the boundary bin of u, and the words still missing at its start.

    `todo` holds the words of the pattern's documents before the place. Histograms of BINS bins, aggregated partially,
    narrow a place down to a bin of BIN_ROWS documents at most or of repeated rows alone.
    """
    spark = rows.sparkSession
    open_ = {k: (-(1 << 63), (1 << 63) - 1, gap) for k, gap in todo.items()}
    done: dict[tuple, tuple[int, int, int]] = {}
    while open_:
        keys = list(open_)
        bounds = spark.createDataFrame([(list(k[0]), i, *open_[k]) for i, k in enumerate(keys)], "p array<string>, i int, low long, high long, gap long")
        # (u - low) / width without overflow: in decimal
        width = F.expr("cast(high as decimal(20)) - cast(low as decimal(20)) + 1")
        spot = F.expr("cast(u as decimal(20)) - cast(low as decimal(20))")
        binned = rows.join(F.broadcast(bounds), rows.pattern.eqNullSafe(bounds.p)).where("u >= low and u <= high and size > 0")
        binned = binned.withColumn("bin", F.floor(spot.cast("double") / width.cast("double") * BINS).cast("int"))
        counts = binned.groupBy("i", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).collect()
        following = {}
        for i, k in enumerate(keys):
            gap = open_[k][2]
            mine = sorted((r for r in counts if r.i == i), key=lambda r: r.bin)
            for j, r in enumerate(mine):
                if r.size > gap:
                    if r.n <= BIN_ROWS or r.lo == r.hi:
                        n, hi = r.n, r.hi
                        for later in mine[j + 1 :]:  # more documents to fit into the gap
                            if n + later.n > BIN_ROWS:
                                break
                            n, hi = n + later.n, later.hi
                        done[k] = (r.lo, hi, gap)
                    else:
                        following[k] = (r.lo, r.hi, gap)
                    break
                gap -= r.size
        open_ = following
    return done


_PAID = "transform(stretches, s -> struct(s.source as source, size * size(filter(sequence(0L, times - 1), k -> (k > s.from_lap or (k = s.from_lap and u >= s.from_u)) and (k < s.to_lap or (k = s.to_lap and u < s.to_u)))) as taken))"


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", sources: str = "array(source)") -> DataFrame:
    """Rows (doc_id, pattern, size, source_size, target, taken, u, credited), one for each input row.

    `sources` is SQL for a document's array of sources, which may overlap; a null source is one of its own, last in
    order. Quotas share `share` times all words by the repeating `weights`, in code point order of the sources, each
    `repeats` times its source at most. Documents meet their quotas through `route`: all documents of a pattern are
    taken k times, and a seeded choice of them once more, up to the flow that the pattern got; `taken` is a multiple
    of size, and `credited` says how much of it counts for which source, along the flow's arcs. The choice is a
    threshold on a seeded hash: histograms of BINS bins (partially aggregated, however hot a source is) find the bin
    in which the flow ends, again inside that bin until it has BIN_ROWS documents at most, and join the next bins up
    to that number; of these, documents are taken in seeded order while they fit. So a pattern misses its flow by
    less than its last bin's shortest document left out, and no task sees more than a bin; where two sources share a
    pattern, their stretches meet within a bin's width. source_size and target are those of the pattern's first source.

    Repeated rows with one id and text share their fate unless the last bin divides them. Texts that are null or
    have no word take nothing. The driver holds one row for each pattern. An empty table gives no rows.
    """
    rows = materialize(sized(docs, id_col, text_col, sources, seed))
    cut, picked = _plan(rows, weights, share, repeats)
    joined = rows.join(F.broadcast(cut), rows.pattern.eqNullSafe(cut.p), "left")  # as many rows as patterns
    within = F.expr("coalesce(u >= low and u <= high and size > 0, false)")
    rest = joined.where(~within).withColumn("times", F.expr("if(size > 0, base + cast(coalesce(u < low, false) as long), 0L)"))
    # a group of repeated rows is one until here
    edge = joined.where(within).groupBy("doc_id", "pattern", "size", "u", "base", "source_size", "target", "stretches").agg(F.count("*").alias("many"))
    edge = edge.join(F.broadcast(picked), edge.doc_id.eqNullSafe(picked.pd) & (edge.u == picked.pu), "left")  # BIN_ROWS for each pattern
    edge = edge.withColumn("k", F.explode(F.expr("sequence(1L, many)"))).withColumn("times", F.expr("base + cast(k <= coalesce(picks, 0) as long)"))
    credited = F.expr(f"if(times > 0, {_PAID}, array())").alias("credited")
    cols = ["doc_id", "pattern", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "u", credited]
    return rest.select(*cols).unionByName(edge.select(*cols))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", sources: str = "array(source)") -> DataFrame:
    """The mixture itself: rows of `docs`, all columns, each as many times as `mix_sources` takes it (perhaps none).

    The plan is made on narrow rows; texts are read once more and decided where they lie, against a row for each
    pattern and BIN_ROWS picks at most for each. Only repeated rows that the last bin divides are grouped.
    """
    rows = materialize(sized(docs, id_col, text_col, sources, seed))
    cut, picked = _plan(rows, weights, share, repeats)
    own = docs.withColumns({"__u": _order(seed, id_col, text_col), "__key": F.col(id_col).cast("long"), "__pattern": F.expr(sources), "__words": F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))})
    small = F.broadcast(cut.select(F.col("p").alias("__p"), F.col("base").alias("__base"), F.col("low").alias("__low"), F.col("high").alias("__high")))
    own = own.where("__words").join(small, F.col("__pattern").eqNullSafe(F.col("__p")))
    picks = F.broadcast(picked.select(F.col("pd").alias("__pd"), F.col("pu").alias("__pu"), F.col("n").alias("__n"), F.col("picks").alias("__picks")))
    own = own.join(picks, F.col("__key").eqNullSafe(F.col("__pd")) & (F.col("__u") == F.col("__pu")), "left")
    more = F.expr("case when __u < __low then 1L when __u > __high or __low is null then 0L when __picks = __n then 1L else 0L end")
    divided = F.expr("coalesce(__u >= __low and __u <= __high and __picks > 0 and __picks < __n, false)")
    out = own.where(~divided).withColumn("__copies", F.col("__base") + more)
    if not picked.where("picks > 0 and picks < n").isEmpty():
        parts = own.where(divided).withColumn("__order", whole_row_hash(docs)).groupBy(*docs.columns, "__u", "__key", "__base", "__picks", "__order").agg(F.count("*").alias("__many"))
        before = F.expr("coalesce(sum(__many) over (partition by __u, __key order by __order rows between unbounded preceding and 1 preceding), 0)")
        parts = parts.withColumn("__copies", F.col("__base") * F.col("__many") + F.least("__many", F.greatest(F.col("__picks") - before, F.lit(0))))
        out = out.select(*docs.columns, "__copies").unionByName(parts.select(*docs.columns, "__copies"))
    return out.where("__copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).select(*docs.columns)
