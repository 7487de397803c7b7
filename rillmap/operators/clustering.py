"""Clusters of each year's documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.functions.vectors import l2, usable_vector
from rillmap.operators.blocks import matrix, summed
from rillmap.operators.lineage import cut
from rillmap.operators.pca import by_group, principal, rows_of, unit_rows

#: Seeding: so many rounds over all documents, each of which adds OVER * k candidates.
SEED_ROUNDS, OVER = 3, 2
#: Rounds of updates, at most. A year above PART_ROWS documents is dealt to PARTS mini-batches at most, one a round.
ROUNDS, PARTS, PART_ROWS = 24, 8, 50_000


@dataclass
class YearClusters:
    """Documents with a cluster_id, and what became of each year: (year, status, docs)."""

    docs: DataFrame
    report: DataFrame


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its nearest centre; rounding next to a centre is nothing."""
    own = (x * x).sum(1)
    near = own + ((c * c).sum(1) - 2 * x @ c.T).min(1)
    return np.where(near > 1e-12 * np.maximum(own, 1), near, 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that hang on the hash and the salt alone."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _recluster(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Centres of seeded k-means over weighted candidates."""
    rng = np.random.default_rng(seed)
    centre = [x[int(rng.choice(len(x), p=weight / weight.sum()))]]
    near = ((x - centre[0]) ** 2).sum(1)
    while len(centre) < k and (total := (near * weight).sum()) > 0:
        centre.append(x[int(rng.choice(len(x), p=near * weight / total))])
        near = np.minimum(near, ((x - centre[-1]) ** 2).sum(1))
    c, label = np.array(centre), None
    for _ in range(rounds):
        new = _nearest(x, c)
        if label is not None and (new == label).all():
            break
        label = new
        for j in range(len(c)):
            if weight[label == j].sum() > 0:
                c[j] = np.average(x[label == j], axis=0, weights=weight[label == j])
    return c


def _seeds(placed: DataFrame, k: int, seed: int) -> dict[int, np.ndarray]:
    """First centres of each year: candidates drawn in rounds over all documents, weighted, clustered on the driver.

    A round draws OVER * k documents of a year with odds as the squared distance to the nearest candidate so far
    (those with the largest ln(u) / distance, u a uniform number from the document's hash), so it needs one pass and no
    sum before it. Then each candidate weighs as many documents as are nearest to it.
    """
    context = placed.sparkSession.sparkContext
    found = {r.year: [np.array(r.z)] for r in placed.groupBy("year").agg(F.min_by("z", F.struct("h", "z")).alias("z")).collect()}
    most = OVER * k
    for step in range(SEED_ROUNDS if k > 1 else 0):
        held = context.broadcast({y: np.array(c) for y, c in found.items()})  # candidates: some rows for each cluster

        def draw(batches, held=held, step=step):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for year, part, z in by_group(batch, 0, 2):
                    near = _distances(z, held.value[year])
                    far = near > 0
                    key = np.log(_uniform(part.column(1).to_numpy()[far], seed * 1000 + step)) / near[far]
                    old = best.get(year, (np.zeros(0), np.zeros((0, z.shape[1]))))
                    key, z = np.concatenate([old[0], key]), np.concatenate([old[1], z[far]])
                    top = np.argsort(-key, kind="stable")[:most]
                    best[year] = key[top], z[top]
            for year, (key, z) in best.items():
                yield pa.record_batch([pa.array([year] * len(key), pa.int32()), pa.array(key), pa.array(list(z), pa.list_(pa.float64()))], ["year", "key", "z"])

        drawn = placed.mapInArrow(draw, "year int, key double, z array<double>")
        top = drawn.withColumn("place", F.expr("row_number() over (partition by year order by key desc, z)")).where(F.col("place") <= most)
        for r in top.orderBy("year", "place").collect():
            found[r.year].append(np.array(r.z))
    candidates = {y: np.unique(np.array(c), axis=0) for y, c in found.items()}
    held = context.broadcast(candidates)

    def weigh(batches):
        for batch in batches:
            for year, _, z in by_group(batch, 0, 2):
                c = held.value[year]
                yield year, 0, np.bincount(_nearest(z, c), minlength=len(c)).astype(float)[:, None]

    weights = {r.p: matrix(r.x, r.height)[:, 0] for r in summed(placed, weigh).collect()}
    return {y: _recluster(c, weights[y], min(k, len(c)), seed) for y, c in candidates.items()}


def _refined(placed: DataFrame, centres: dict[int, np.ndarray], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Centres after rounds of mini-batch updates, all years at once.

    A year's documents are dealt by hash to up to PARTS batches of PART_ROWS or more; a year with fewer goes whole. A centre moves to the
    mean of what it has been given since its epoch began, so an epoch of one batch is a plain k-means round. It ends
    when an epoch moves no centre.
    """
    context = placed.sparkSession.sparkContext
    parts = {y: max(1, min(PARTS, sizes[y] // PART_ROWS)) for y in centres}
    given = {y: np.zeros((len(c), c.shape[1] + 1)) for y, c in centres.items()}
    before = {y: c.copy() for y, c in centres.items()}
    live = set(centres)
    for step in range(ROUNDS):
        held = context.broadcast({y: centres[y] for y in live})  # a row for each cluster

        def add(batches, held=held, step=step):
            for batch in batches:
                for year, part, z in by_group(batch, 0, 2):
                    if year in held.value:
                        now = part.column(1).to_numpy() % parts[year] == step % parts[year]
                        if now.any():
                            z, c = z[now], held.value[year]
                            label = _nearest(z, c)
                            order = np.argsort(label, kind="stable")
                            heads = np.flatnonzero(np.diff(label[order], prepend=-1))
                            total = np.zeros((len(c), z.shape[1] + 1))
                            total[label[order][heads]] = np.add.reduceat(np.hstack([np.ones((len(z), 1)), z])[order], heads)
                            yield year, 0, total

        for r in summed(placed, add).collect():
            given[r.p] += matrix(r.x, r.height)
            some = given[r.p][:, 0] > 0
            centres[r.p][some] = given[r.p][some, 1:] / given[r.p][some, :1]
        for y in list(live):
            if (step + 1) % parts[y] == 0:  # an epoch is over
                if np.abs(centres[y] - before[y]).max() < 1e-9:
                    live.discard(y)
                before[y] = centres[y].copy()
                given[y][:] = 0
        if not live:
            break
    return centres


def fit_years(docs: DataFrame, k: int, seed: int = 42, dims: int = 50, on_bad: str = "skip") -> YearClusters:
    """`docs` with a cluster_id, by k-means of each year's unit vectors after principal components.

    Components, first centres and updates come from all documents of all years; years of any size go through the same
    passes, each a sum by year. The driver holds a basis and some rows for each cluster. Clusters are
    numbered by size, then smallest id. Labels are put on in the row, so no document is joined, and rows that share an
    id stay as many as they are.

    Documents without a year or a usable vector (text is parsed) get no cluster, nor do those whose vector is not as
    wide as most of their year's (ties: the narrower); with on_bad="fail" they raise instead. A year whose components cannot
    be found loses its documents and no other's. `report` has (year, status, docs) for all that: clustered, unusable
    vector, other width, or `error: ..`.
    """
    spark = docs.sparkSession
    plain = docs.drop("cluster_id")
    year, vector = F.col("year").cast("int"), usable_vector(plain, "embedding")
    unit = cut(plain.select(year.alias("year"), F.xxhash64("doc_id").alias("h"), "doc_id", l2(vector).alias("u")).where("year is not null"))
    counted = unit.groupBy("year", F.coalesce(F.size("u"), F.lit(-1)).alias("width")).agg(F.count("*").alias("n")).collect()  # a row for each width of a year
    widths: dict[int, tuple[int, int]] = {}
    for r in counted:
        if r.width > 0:
            widths[r.year] = max(widths.get(r.year, (0, 0)), (r.n, r.width), key=lambda x: (x[0], -x[1]))
    report = [(r.year, "unusable vector" if r.width <= 0 else "other width", r.n) for r in counted if r.width <= 0 or r.width != widths[r.year][1]]
    if report and on_bad == "fail":
        raise ValueError("; ".join(f"{y}: {n} documents with {status}" for y, status, n in sorted(report)))
    held = spark.createDataFrame([(y, w) for y, (_, w) in sorted(widths.items())], "year int, width int")
    unit = unit.join(F.broadcast(held), (unit.year == held.year) & (F.size("u") == held.width)).select(unit.year, "h", "u", "doc_id")  # a row for each year
    bases = principal(unit.select("year", "u"), dims)
    report += [(y, f"error: {b.error}", widths[y][0]) for y, b in bases.items() if b.error]
    bases = {y: b.basis for y, b in bases.items() if not b.error}
    turned = spark.sparkContext.broadcast(bases)

    def project(batches):
        for batch in batches:
            for y, part, x in by_group(batch, 0, 2):
                if y in turned.value:
                    z = x @ turned.value[y]
                    yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel())), part.column(3)], ["year", "h", "z", "doc_id"])

    placed = cut(unit.mapInArrow(project, f"year int, h long, z array<double>, doc_id {docs.schema['doc_id'].dataType.simpleString()}"))
    centres, order = _solved(placed, {y: widths[y][0] for y in bases}, k, seed)
    last = spark.sparkContext.broadcast(centres)
    numbers = spark.sparkContext.broadcast({y: np.array([order.get((y, j), -1) for j in range(len(c))], np.int32) for y, c in centres.items()})
    # not to be reckoned twice, for the filter and for the column; the length is taken in it, as an aggregate in an Arrow function's argument is not planned
    name = F.arrow_udf(lambda y, u: _labels(y, u, turned.value, last.value, numbers.value), "int").asNondeterministic()
    report += [(y, "clustered", widths[y][0]) for y in bases]
    return YearClusters(plain.withColumn("cluster_id", name(year, vector)).where("cluster_id is not null"), spark.createDataFrame(sorted(report), "year int, status string, docs long"))


def _solved(placed: DataFrame, sizes: dict[int, int], k: int, seed: int) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], int]]:
    """Centres of each year's rows (year, h, z, doc_id), and the number of each: by size, then least doc_id."""
    centres = _refined(placed, _seeds(placed, k, seed), sizes) if sizes else {}
    held = placed.sparkSession.sparkContext.broadcast(centres)
    label = F.arrow_udf(lambda y, z: _labels(y, z, {}, held.value, {}), "int")
    counts = placed.groupBy("year", label("year", "z").alias("j")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    ranked = counts.select("year", "j", F.expr("row_number() over (partition by year order by n desc, least) - 1").alias("c"))
    return centres, {(r.year, r.j): r.c for r in ranked.collect()}  # a row for each cluster


def group_vectors(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster) by the same k-means over all rows (id, z), vectors of one width, as one group."""
    kind = rows.schema["id"].dataType.simpleString()
    placed = cut(rows.select(F.lit(0).alias("year"), F.xxhash64("id").alias("h"), F.col("z").cast("array<double>").alias("z"), F.col("id").alias("doc_id")))
    n = placed.count()
    centres, order = _solved(placed, {0: n} if n else {}, k, seed)

    def name(batches):
        for batch in batches:
            found = _nearest(rows_of(batch.column(1)), centres[0])
            yield pa.record_batch([batch.column(0), pa.array([order[0, j] for j in found.tolist()], pa.int32())], ["id", "cluster"])

    return placed.select(F.col("doc_id").alias("id"), "z").mapInArrow(name, f"id {kind}, cluster int")


def _labels(years: pa.Array, vectors: pa.Array, bases: dict, centres: dict, numbers: dict) -> pa.Array:
    """The cluster of each row's vector, null without one; with `bases` the vectors are given as they are, else as placed."""
    out = np.full(len(years), -1, np.int32)
    own = years.fill_null(-(1 << 31)).to_numpy(zero_copy_only=False)
    width = np.array(pc.fill_null(pc.list_value_length(vectors), -1))
    for year in np.unique(own).tolist():
        if year in centres:
            wide = len(bases[year]) if bases else centres[year].shape[1]
            at = np.flatnonzero((own == year) & (width == wide))
            if len(at):
                x = rows_of(vectors.take(pa.array(at)))
                found = _nearest(unit_rows(x) @ bases[year] if bases else x, centres[year])
                out[at] = numbers[year][found] if numbers else found
    return pa.array(out, mask=out < 0)


def cluster_years(docs: DataFrame, k: int, seed: int = 42, dims: int = 50) -> DataFrame:
    """(doc_id, year, cluster_id) of the documents that have a cluster."""
    return fit_years(docs, k, seed, dims).docs.select("doc_id", F.col("year").cast("int").alias("year"), "cluster_id")
