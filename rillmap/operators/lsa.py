"""Latent semantic spaces of many scopes at once: a randomised block singular value decomposition of long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmap.operators.blocks import DENSE as _DENSE
from rillmap.operators.blocks import HELD
from rillmap.operators.blocks import matrix as _matrix
from rillmap.operators.blocks import record as _record
from rillmap.operators.blocks import summed
from rillmap.operators.lineage import cut, release

#: Documents of a block; a dense block of documents is ROWS x (components + EXTRA) numbers, small enough for a row of a table.
ROWS = 128
#: Terms and entries of a slab, and directions of a slice: a task multiplies one slab by one slice at a time, and holds
#: COLUMNS x SLICE numbers and the slab's entries.
COLUMNS, NONZEROS, SLICE = 1 << 17, 1 << 21, 68
#: Blocks that lie in one task, so that its products of columns are few beside them.
GROUP = 16
#: Entries that are multiplied at once.
STEP = 1 << 12
#: Directions beyond the wanted ones, and rounds over the matrix that sharpen them.
EXTRA, POWERS = 16, 2
#: Directions weaker than this share of the strongest count as none.
LEAST = 1e-13


def _indexed(rows: DataFrame, key: str, parts: Column, block: str, place: str) -> DataFrame:
    """Rows (p, key, ..) with their block within p, by hash, of as many as the aggregate `parts` says, and their place in it."""
    n = rows.groupBy("p").agg(parts.alias("parts"))
    rows = rows.join(n, "p").withColumn(block, F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    w = Window.partitionBy("p", block)
    order = F.row_number().over(w.orderBy(key)) - 1
    return rows.withColumn(place, order).withColumn(f"{block}_rows", F.count("*").over(w).cast("int")).drop("parts")


def _directions(h: np.ndarray, wide: int) -> np.ndarray:
    """Random numbers between -1 and 1, `wide` of them for each 64-bit hash of a term, the same wherever the term is met."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, wide + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) * 2.0**-63 - 1


def _add(total: np.ndarray, to: np.ndarray, rows: Callable[[slice], np.ndarray], w: np.ndarray) -> None:
    """total[to] += w * rows, `to` ascending, STEP rows at a time."""
    for lo in range(0, len(w), STEP):
        part = slice(lo, lo + STEP)
        heads = np.flatnonzero(np.diff(to[part], prepend=-1))
        total[to[part][heads]] += np.add.reduceat(rows(part) * w[part, None], heads)


_CELLS = "p int, i int, j int, height int, width int, r binary, c binary, w binary"


def _blocks(entries: DataFrame, wide: dict[int, int]) -> DataFrame:
    """For each block of documents its sparse cells, one for each slab of terms, and a row with j = -1.

    That has x, the block's product with random directions of all terms, and d: of each document the squared weights of
    the terms that are its alone (without a slab).
    """
    dealt = entries.repartition("p", F.floor(F.col("i") / GROUP)).sortWithinPartitions("p", "i", "j", "r")

    def gather(batches):
        for p, i, rows in _runs(batches, ("p", "i")):
            height = rows.column("i_rows")[0].as_py()
            j, width, r, c, w, h = (rows.column(x).to_numpy() for x in ("j", "j_rows", "r", "c", "w", "h"))
            order, x = np.argsort(r, kind="stable"), np.zeros((height, wide[p]))
            to, ordered, hashes = r[order], w[order], h[order].view(np.uint64)
            _add(x, to, lambda part, hashes=hashes, p=p: _directions(hashes[part], wide[p]), ordered)
            d = np.bincount(r[j < 0], w[j < 0] ** 2, height)
            yield _packed(p, i, -1, height, 0, None, None, None, x, d)
            for lo, hi in _spans(j):
                if j[lo] >= 0:
                    yield _packed(p, i, j[lo], height, width[lo], r[lo:hi], c[lo:hi], w[lo:hi], None, None)

    return dealt.mapInArrow(gather, f"{_CELLS}, x binary, d binary")


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal numbers."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:], strict=False))


def _packed(p: int, i: int, j: int, height: int, width: int, r, c, w, x, d) -> pa.RecordBatch:
    kinds = {"r": "<i4", "c": "<i4", "w": "<f8", "x": "<f8", "d": "<f8"}
    arrays = {k: pa.array([v if v is None else np.ascontiguousarray(v, kinds[k]).tobytes()], pa.binary()) for k, v in zip(kinds, (r, c, w, x, d), strict=True)}
    numbers = {k: pa.array([int(v)], pa.int32()) for k, v in zip(("p", "i", "j", "height", "width"), (p, i, j, height, width), strict=True)}
    return pa.record_batch(numbers | arrays)


def _runs(batches, keys: tuple[str, ...]) -> Iterator[tuple]:
    """(*key, rows) of each run of equal keys in a sorted partition."""
    held, own = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != own:
                yield (*own, pa.Table.from_batches(held).combine_chunks())
                held = []
            own = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield (*own, pa.Table.from_batches(held).combine_chunks())


#: Dense blocks with the squared weights of terms that are a document's alone.
_HELD_BLOCKS = f"{_DENSE}, d binary"


def _around(cells: DataFrame, blocks: DataFrame, by: dict[int, np.ndarray], slabs: dict[int, int]) -> DataFrame:
    """The matrix times its transpose times q, q being every block times its scope's small matrix: blocks like `blocks`,
    and rows with b = -1 whose x add up, for each scope, to the products of q with that.

    Terms of one document alone only scale its row, so just the others meet: slices of q and cells of a slab go to one
    task, which adds up the slab's rows of terms, multiplies them back and forgets them. No row for a term is dealt.
    """
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast(by)  # a small square for each scope
    slices = spark.createDataFrame([(p, v) for p, m in by.items() for v in range(-(-m.shape[1] // SLICE))], "p int, v int")

    def slice_up(batches):
        for batch in batches:
            for s in batch.to_pylist():
                q = _matrix(s["x"], s["height"]) @ held.value[s["p"]]
                for v in range(-(-q.shape[1] // SLICE)):
                    raw = np.ascontiguousarray(q[:, v * SLICE : (v + 1) * SLICE]).tobytes()
                    for j in range(slabs.get(s["p"], 0)):
                        yield pa.record_batch([*(pa.array([k], pa.int32()) for k in (s["p"], s["b"], j, v, s["height"])), pa.array([raw])], ["p", "i", "j", "v", "height", "x"])

    sent = blocks.mapInArrow(slice_up, "p int, i int, j int, v int, height int, x binary")
    copies = cells.select("p", "i", "j", "height", "width", "r", "c", "w").join(F.broadcast(slices), "p")
    dealt = sent.unionByName(copies, allowMissingColumns=True).repartition("p", "j", "v").sortWithinPartitions("p", "j", "v", "i", F.col("x").isNull())

    def multiply(batches):
        own, z, q, mine = None, None, None, []

        def back():
            for i, height, r, c, w in mine:
                y = np.zeros((height, z.shape[1]))
                _add(y, r, lambda part, c=c: z[c[part]], w)
                yield pa.record_batch([*(pa.array([k], pa.int32()) for k in (own[0], i, own[2], height)), pa.array([y.tobytes()])], ["p", "b", "v", "height", "x"])

        for batch in batches:
            for s in batch.to_pylist():
                if (s["p"], s["j"], s["v"]) != own:
                    yield from back()
                    own, z, mine = (s["p"], s["j"], s["v"]), None, []
                if s["x"] is not None:
                    q = _matrix(s["x"], s["height"])
                    continue
                r, c, w = (np.frombuffer(s[k], t) for k, t in (("r", "<i4"), ("c", "<i4"), ("w", "<f8")))
                z = np.zeros((s["width"], q.shape[1])) if z is None else z
                order = np.argsort(c, kind="stable")
                source = r[order]
                _add(z, c[order], lambda part, source=source, q=q: q[source[part]], w[order])
                mine.append((s["i"], s["height"], r, c, w))
        yield from back()

    parts = dealt.mapInArrow(multiply, "p int, b int, v int, height int, x binary")
    met = blocks.withColumn("v", F.lit(-1)).unionByName(parts, allowMissingColumns=True).repartition("p", F.floor(F.col("b") / GROUP)).sortWithinPartitions("p", "b", "v")

    def gather(batches):
        own, q, y, d, squares = None, None, None, None, {}

        def whole():
            if own is None:
                return
            p, b = own
            squares[p] = squares.get(p, 0) + q.T @ y
            yield pa.record_batch([*(pa.array([k], pa.int32()) for k in (p, b, len(y))), pa.array([y.tobytes()]), pa.array([d])], ["p", "b", "height", "x", "d"])
            if sum(x.nbytes for x in squares.values()) > HELD:
                yield from added()

        def added():
            for p, x in squares.items():
                yield pa.record_batch([*(pa.array([k], pa.int32()) for k in (p, -1, len(x))), pa.array([x.tobytes()]), pa.array([None], pa.binary())], ["p", "b", "height", "x", "d"])
            squares.clear()

        for batch in batches:
            for s in batch.to_pylist():
                x = _matrix(s["x"], s["height"])
                if (s["p"], s["b"]) != own:
                    yield from whole()
                    own, q, d = (s["p"], s["b"]), x @ held.value[s["p"]], s["d"]
                    y = np.frombuffer(d)[:, None] * q
                else:
                    y[:, s["v"] * SLICE : (s["v"] + 1) * SLICE] += x
        yield from whole()
        yield from added()

    return met.mapInArrow(gather, _HELD_BLOCKS)


def _squares(dense: DataFrame, by: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The products of all columns with each other, a small square for each p, on the driver; of blocks times their
    scope's matrix with `by`, else the blocks are such squares already and are added up."""
    held = by and dense.sparkSession.sparkContext.broadcast(by)  # a small square for each scope

    def square(batches):
        for batch in batches:
            for s in batch.to_pylist():
                x = _matrix(s["x"], s["height"])
                if held:
                    x = x @ held.value[s["p"]]
                    x = x.T @ x
                yield s["p"], 0, x.copy() if not held else x

    return {r.p: _matrix(r.x, r.height) for r in summed(dense, square).collect()}


def _turned(dense: DataFrame, by: dict[int, np.ndarray]) -> DataFrame:
    """Every block times its scope's small matrix."""
    held = dense.sparkSession.sparkContext.broadcast(by)  # a small square for each scope

    def turn(batches):
        for batch in batches:
            for s in batch.to_pylist():
                yield _record(s["p"], s["b"], _matrix(s["x"], s["height"]) @ held.value[s["p"]])

    return dense.select("p", "b", "height", "x").mapInArrow(turn, _DENSE)


def _unit(squares: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """What turns columns with these products into orthonormal ones."""
    by = {}
    for p, g in squares.items():
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        keep = values > max(values[-1], 0) * LEAST
        by[p] = vectors[:, keep] / np.sqrt(values[keep])
    return by


def _orthogonal(dense: DataFrame, by: dict[int, np.ndarray], times: int = 1) -> dict[int, np.ndarray]:
    """`by`, turned further so that the blocks times it have orthonormal columns that span the same space; a second time for accuracy."""
    for _ in range(times):
        by = _joined(by, _unit(_squares(dense, by)))
    return by


def _joined(by: dict[int, np.ndarray], then: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {p: m @ then[p] for p, m in by.items()}


def latent_rows(w: DataFrame, sizes: dict[int, int], most: int = 256, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents (p, doc, i, r), blocks (p, b, height, x)): row r of block i is the document in its scope's latent space.

    `w` has (p, doc, term, w), each scope p a sparse matrix of documents by terms; `sizes` says how many documents each
    has, those without a term included. The space is that of the k strongest singular vectors, k being `most`, or one
    less than the documents or terms, and 2 at least; rows are as projected, not scaled to length one.

    The matrix lies in sparse cells, dealt once. Its product with seeded random directions, k + EXTRA of them, needs a
    document's own terms only; it goes through the transpose and back in POWERS rounds (none where all scopes are
    covered), in tasks that hold a slab of terms and a slice of directions. Between them the driver only turns small
    squares (k + EXTRA wide, one for each scope), the bases are kept as the last product and the turns it wants. Where
    k + EXTRA covers the rank the space is exact, else its weaker directions are approximate.
    """
    entries = w.select("p", "doc", "term", "w")
    docs = cut(_indexed(entries.select("p", "doc").distinct(), "doc", F.ceil(F.count("*") / ROWS), "i", "r"))
    counts = cut(entries.groupBy("p", "term").agg(F.count("*").alias("df")))
    parts = F.greatest(F.ceil(F.count("*") / COLUMNS), F.ceil(F.sum("df") / NONZEROS))
    terms = cut(_indexed(counts.where("df > 1"), "term", parts, "j", "c").drop("df"))
    shapes = {r.p: r for r in docs.groupBy("p").agg(F.count("*").alias("n")).join(counts.groupBy("p").agg(F.count("*").alias("m")), "p").collect()}  # a row for each scope
    slabs = {r.p: r.slabs for r in terms.groupBy("p").agg((F.max("j") + 1).alias("slabs")).collect()}  # the same
    wanted = {p: min(most, max(2, min(s.m, sizes.get(p, s.n)) - 1), s.n, s.m) for p, s in shapes.items()}
    wide = {p: min(wanted[p] + EXTRA, s.n, s.m) for p, s in shapes.items()}
    placed = entries.join(docs, ["p", "doc"]).join(terms, ["p", "term"], "left").select("p", "i", "i_rows", "r", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("j", -1), ("j_rows", 0), ("c", -1))), "w", F.xxhash64("p", "term", F.lit(seed)).alias("h"))
    made = cut(_blocks(placed, wide))
    cells, y = made.where("j >= 0"), made.where("j < 0").select("p", F.col("i").alias("b"), "height", "x", "d")
    release(w.sparkSession)
    by = {p: np.eye(k) for p, k in wide.items()}
    covered = all(wide[p] == min(s.n, s.m) for p, s in shapes.items())  # then the first product spans all there is
    for _ in range(0 if covered else POWERS):
        made = cut(_around(cells, y, _orthogonal(y, by), slabs))
        # q's products with this are those of the transpose times q with itself: turned by them, it is the matrix times a basis of that
        y, by = made.where("b >= 0"), _unit(_squares(made.where("b < 0")))
        release(w.sparkSession)
    by = _orthogonal(y, by, 2)
    turns = {}
    for p, g in _squares(_around(cells, y, by, slabs).where("b < 0")).items():
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        k = min(wanted[p], len(values))
        turns[p] = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
    return docs.select("p", "doc", "i", "r"), _turned(y, _joined(by, turns))


def latent_centroids(docs: DataFrame, blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(p, side, cluster, n, vector): means of the documents' rows scaled to length one.

    `labels` has (p, doc, side, cluster). Labels meet the blocks as one list for each block; a task adds up its blocks first.
    """
    place = docs.join(labels, ["p", "doc"]).groupBy("p", F.col("i").alias("b")).agg(F.collect_list(F.struct("r", "side", "cluster")).alias("own"))
    met = blocks.join(place, ["p", "b"])
    kinds = "p int, side int, cluster int, n long, s array<double>"

    def sums(batches):
        total: dict[tuple[int, int, int], list] = {}

        def added():
            for (p, side, cluster), (n, x) in total.items():
                yield pa.record_batch([*(pa.array([k], pa.int32()) for k in (p, side, cluster)), pa.array([n], pa.int64()), pa.array([x], pa.list_(pa.float64()))], ["p", "side", "cluster", "n", "s"])
            total.clear()

        size = 0
        for batch in batches:
            for s in batch.to_pylist():
                z = _matrix(s["x"], s["height"])
                z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                own = np.array([(o["side"], o["cluster"], o["r"]) for o in s["own"]])
                pairs, which = np.unique(own[:, :2], axis=0, return_inverse=True)
                for k, pair in enumerate(pairs.tolist()):
                    rows = own[which.ravel() == k, 2]
                    held = total.setdefault((s["p"], *pair), [0, np.zeros(z.shape[1])])
                    size += held[1].nbytes * (held[0] == 0)
                    held[0] += len(rows)
                    held[1] += z[rows].sum(0)
                if size > HELD:
                    yield from added()
                    size = 0
        yield from added()

    parts = met.mapInArrow(sums, kinds)
    flat = parts.select("p", "side", "cluster", "n", F.posexplode("s").alias("k", "x")).groupBy("p", "side", "cluster", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"])
    return flat.groupBy("p", "side", "cluster").agg(F.first("n").alias("n"), ordered.alias("s")).select("p", "side", "cluster", "n", F.expr("transform(s, x -> x / n)").alias("vector"))


#: Clusters of a tile.
TILE = 512


def best_matches(before: DataFrame, after: DataFrame, tile: int = TILE) -> DataFrame:
    """(p, prev_id, next_id, similarity): for each vector of `before` the one of `after` in its scope with the largest cosine.

    Both have (p, id, vector). A scope's vectors are laid in tiles of about `tile`, and pairs of tiles are multiplied
    as matrices; of each product only every row's best goes on (ties, to nine places, to the smaller id), so no row
    for a pair is made. Zero vectors have a cosine of 0 with all.
    """

    def tiled(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy("p").agg(F.ceil(F.count("*") / tile).alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).alias(f"t{name}")
        return rows.join(n, "p").select("p", part, F.struct("id", "vector").alias("row")).groupBy("p", f"t{name}").agg(F.sort_array(F.collect_list("row")).alias(name))

    def product(batches):
        for batch in batches:
            for s in batch.to_pylist():
                a, b = (np.array([r["vector"] for r in s[k]]) for k in ("a", "b"))
                a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
                near = np.round(a @ b.T, 9)
                at = near.argmax(1)
                columns = [pa.array([s["p"]] * len(a), pa.int32()), pa.array([r["id"] for r in s["a"]], pa.int32()), pa.array([s["b"][k]["id"] for k in at.tolist()], pa.int32()), pa.array(near[np.arange(len(a)), at])]
                yield pa.record_batch(columns, ["p", "prev_id", "next_id", "similarity"])

    found = tiled(before, "a").join(tiled(after, "b"), "p").select("p", "a", "b").mapInArrow(product, "p int, prev_id int, next_id int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("next_id")).alias("minus"))).alias("best")
    return found.groupBy("p", "prev_id").agg(best).select("p", "prev_id", (-F.col("best.minus")).alias("next_id"), F.col("best.similarity").alias("similarity"))
