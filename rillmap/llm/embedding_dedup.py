"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, local_components, materialize, release

#: Distinct vectors that a cell should be home to, and most pivots (drawn from a bounded sample of the vectors).
CELL, MOST_PIVOTS, SAMPLE = 16384, 4096, 16384
#: Vectors of the sample on which copies are counted.
MEASURED = 2048
#: A cell with more members is joined in pairs of blocks; all vectors make PARTS blocks, of these sizes at least and at most.
LEAST_BLOCK, BLOCK, PARTS = 4096, 65536, 4
#: Rows and columns of a tile of products, and pairs that are judged at once.
ROWS, COLUMNS, JUDGED = 512, 1024, 16384
#: Share of a sample's pairs, of those whose cosine is less by UNLIKE, that the leading directions may leave to be judged.
UNTOLD, UNLIKE = 2e-5, 0.1


def usable(vector: str) -> Column:
    """True for vectors that have a direction: not null or empty, finite, not all zero."""
    return F.expr(f"coalesce(size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0), false)")


def rows_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one width, as they are."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one width, in double precision."""
    return rows_of(column).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample that lie apart: each the one farthest from those before."""
    picked = [0]
    nearest = sample @ sample[0]
    while len(picked) < min(n, len(sample)):
        k = int(nearest.argmin())
        picked.append(k)
        nearest = np.maximum(nearest, sample @ sample[k])
    return sample[picked]


def between(pivots: np.ndarray) -> np.ndarray:
    """The distances of all pivots from each other."""
    return np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 1e-12))


def cells(x: np.ndarray, pivots: np.ndarray, angle: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, angle to its pivot) of all memberships; a row's home comes first.

    Angles are a metric. Were a partner at home with p, within `angle`, then by the triangle inequality
    d(v, p) <= d(v, home) + 2 * angle; v must also lie within `angle` of the halfway plane. Such a cell gets a
    replica where it comes before the home, so that one cell of the two finds the pair.
    """
    cos = np.clip(x @ pivots.T, -1, 1)
    home = cos.argmax(1)
    rows = np.arange(len(x))
    far = np.arccos(cos)
    apart = between(pivots) if apart is None else apart
    near = (far <= far[rows, home][:, None] + 2 * angle + 1e-9) & (cos[rows, home][:, None] - cos <= apart[home] * math.sin(angle) + 1e-9)
    near &= np.arange(len(pivots))[None, :] < home[:, None]
    r, c = np.nonzero(near)
    return np.concatenate([rows, r]), np.concatenate([home, c]), np.concatenate([far[rows, home], far[r, c]])


def leading(sample: np.ndarray, cosine: float) -> np.ndarray:
    """Orthonormal directions (columns) that hold most of the sample, so many that their bound tells unlike pairs apart."""
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    some = sample[:MEASURED]
    unlike = np.triu(some @ some.T < cosine - UNLIKE, 1)
    n = 8
    while n < len(axes):
        z = led(some, axes[:, :n])
        if ((z @ z.T >= cosine) & unlike).sum() <= UNTOLD * unlike.sum():
            break
        n += max(1, n // 4)
    return axes[:, :n]


def led(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Rows along the axes and the length of what is left: their products are at least the cosines (Cauchy and Schwarz)."""
    if axes is None or axes.shape[0] == axes.shape[1]:
        return x.astype(np.float32)
    y = x @ axes
    return np.concatenate([y, np.sqrt(np.maximum(1 - (y * y).sum(1, keepdims=True), 0))], axis=1).astype(np.float32)


def join_cell(raw: np.ndarray, at_home: np.ndarray, far: np.ndarray, block: np.ndarray | None, cosine: float, axes: np.ndarray | None = None):
    """Index pairs (i, j) of a cell's members at `cosine` or more, at least one at home, each pair once.

    Members are ordered by their distance to the pivot; a tile is compared with those alone whose distances differ
    by the radius at most. Single precision along the axes finds candidates, double precision over whole vectors
    decides, JUDGED at a time. With `block` (0 or 1) only the pairs between the two blocks are compared.
    """
    order = np.argsort(far, kind="stable")
    left, right = (order, order) if block is None else (order[block[order] == 0], order[block[order] == 1])
    small = np.concatenate([led(unit(raw[k : k + JUDGED].astype(np.float64)), axes) for k in range(0, len(raw), JUDGED)])
    rows, columns, reach = small[left], np.ascontiguousarray(small[right].T), far[right]
    radius = math.acos(min(1.0, cosine)) + 1e-9
    for lo in range(0, len(left), ROWS):
        hi = min(len(left), lo + ROWS)
        start = lo if block is None else int(np.searchsorted(reach, far[left[lo]] - radius, "left"))
        stop = int(np.searchsorted(reach, far[left[hi - 1]] + radius, "right"))
        for a in range(start, stop, COLUMNS):
            near = rows[lo:hi] @ columns[:, a : min(stop, a + COLUMNS)]
            some = np.flatnonzero(near.max(1) >= cosine - 1e-4)  # most tiles have none
            i, j = np.nonzero(near[some] >= cosine - 1e-4)
            i, j = some[i] + lo, j + a
            if block is None:
                i, j = i[i < j], j[i < j]
            i, j = left[i], right[j]
            keep = at_home[i] | at_home[j]
            i, j = i[keep], j[keep]
            for k in range(0, len(i), JUDGED):
                p, q = i[k : k + JUDGED], j[k : k + JUDGED]
                keep = (unit(raw[p].astype(np.float64)) * unit(raw[q].astype(np.float64))).sum(1) >= cosine
                yield p[keep], q[keep]


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each input row.

    Equal vectors are one class, weighted by their number, before any comparison. Classes meet in pivot cells
    (`cells`); a cell's links are counted where found and summed, and go on as links to their local component's
    root alone, so neither pairs nor a group's square leave a task. A cell of many members is joined in block pairs.
    On data without neighbourhoods in few dimensions the replicas approach all cells: where by a sample cells deal out more
    copies than blocks do, all vectors lie around one pivot and are compared in block pairs, with the same links. Pairs are
    told apart by the directions that hold most of a sample; whole vectors are compared only where these do not.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different widths with each other. A class is known by a number of its own, so rows that repeat an id are vectors
    of their own, each in its own component. A row without an id counts as a vector but never names a component:
    where all of one lack an id, component_id is null; such rows are never `kept`. Extra columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    angle = math.acos(cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", usable("v"))
    # numbers are those of the checkpoint, and so never change
    classes = materialize(rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("v"), "least").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    widths = [len(v) for v in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    many = max(1, min(MOST_PIVOTS, -(-total // CELL)))
    pivots = choose_pivots(unit(np.array([v for v in sample if len(v) == width], float)), many) if widths else np.zeros((1, 1))
    block = max(min(LEAST_BLOCK, BLOCK), min(BLOCK, -(-total // PARTS)))
    if len(pivots) > 1:
        some = unit(np.array([v for v in sample if len(v) == width], float)[:MEASURED])
        held = np.bincount(cells(some, pivots, angle)[1]) * (total / len(some))
        if (held * np.ceil(held / block)).sum() > total * -(-total // block):  # on these data cells deal more copies than block pairs do: all vectors around one pivot
            pivots = pivots[:1]
    shared = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    ahead = spark.sparkContext.broadcast(leading(unit(np.array([v for v in sample if len(v) == width], float)), cosine) if widths else None)
    kind = classes.schema["v"].dataType.simpleString()

    def assign(batches):
        apart = between(shared.value)
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for w in np.unique(lengths):
                mine = np.flatnonzero(lengths == w)
                part = batch.take(pa.array(mine))
                if w == width:
                    row, cell, far = cells(unit(matrix(part.column(0))), shared.value, angle, apart)
                else:  # vectors of another width have a cell of their own
                    row, cell, far = np.arange(len(mine)), np.full(len(mine), -int(w)), np.zeros(len(mine))
                for lo in range(0, len(row), 16384):
                    s = slice(lo, lo + 16384)
                    out = part.take(pa.array(row[s]))
                    yield pa.record_batch([out.column(0), out.column(1), out.column(2), cell[s].astype(np.int64), far[s], np.arange(len(row))[s] < len(mine)], ["v", "rep", "n", "cell", "far", "home"])

    members = classes.select("v", "rep", "n").mapInArrow(assign, f"v {kind}, rep long, n long, cell long, far double, home boolean")
    sizes = members.select("cell").groupBy("cell").count()  # a row for each pivot or width
    split = {r.cell: -(-r["count"] // block) for r in sizes.where(F.col("count") > block).collect()}
    if split:
        blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in split.items() for x in kv])[F.col("cell")], F.lit(1))
    else:
        blocks = F.lit(1)
    members = members.withColumn("nb", blocks.cast("long")).withColumn("own", F.pmod(F.xxhash64("rep", "v"), F.col("nb")))
    dealt = members.select("v", "rep", "n", "cell", "far", "home", "own", F.explode(F.expr("transform(sequence(0L, nb - 1), o -> struct(least(o, own) as x, greatest(o, own) as y))")).alias("pair"))

    def compare(table: pa.Table) -> pa.Table:
        x = rows_of(table.column("v").combine_chunks())
        axes = ahead.value if ahead.value is not None and ahead.value.shape[0] == x.shape[1] else None
        rep, n, home, far, own = (table.column(c).to_numpy() for c in ("rep", "n", "home", "far", "own"))
        first, second = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        count = np.zeros(len(x), np.int64)
        a, b, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        waiting = 0
        for i, j in join_cell(x, home, far, None if first == second else (own == second), cosine, axes):
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            held.append((i, j))
            waiting += len(i)
            if waiting > 2_000_000 or len(held) > 2000:
                a, b, held, waiting = *_forest(len(x), a, b, held), [], 0
        a, b = _forest(len(x), a, b, held)
        some = np.flatnonzero(count)
        return pa.table({
            "a": np.concatenate([rep[some], rep[a]]),
            "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), rep[b]]), mask=np.arange(len(some) + len(a)) < len(some)),
            "n": np.concatenate([count[some], np.zeros(len(a), np.int64)]),
        })

    found = materialize(dealt.select("v", "rep", "n", "cell", "far", "home", "own", "pair.x", "pair.y").groupBy("cell", "x", "y").applyInArrow(compare, "a long, b long, n long"))
    release(spark)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = classes.join(counts, "rep", "left").join(roots, classes.rep == roots.node, "left")
    known = known.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("v").alias("own_v"), "n_links", "component_id")
    ok, rest = rows.where("ok"), rows.where("not ok")
    out = ok.join(named, ok.v == named.own_v).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _forest(n: int, a: np.ndarray, b: np.ndarray, held: list) -> tuple[np.ndarray, np.ndarray]:
    root = local_components(n, np.concatenate([a, *(p for p, _ in held)]), np.concatenate([b, *(q for _, q in held)]))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]
