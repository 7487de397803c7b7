"""Principal components of many groups at once, over all rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.functions.vectors import l2, usable_vector
from rillmap.operators.blocks import matrix, summed


@dataclass
class Basis:
    """Of one group: how many rows, their mean, and the components as columns; or why there is none."""

    n: int
    mean: np.ndarray
    basis: np.ndarray
    error: str | None = None


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_group(batch: pa.RecordBatch, group: int = 0, vector: int = 1):
    """(group, its rows of the batch, their vectors)."""
    groups = batch.column(group).to_numpy()
    for g in np.unique(groups).tolist():
        part = batch.filter(pa.array(groups == g))
        yield g, part, rows_of(part.column(vector))


def components(products: np.ndarray, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, basis) from the products of all columns of [1, x] with each other.

    min(most, width, n - 1) components, strongest first, the largest entry of each positive; the identity, and no
    mean, where that leaves fewer than two.
    """
    n, d = int(round(products[0, 0])), len(products) - 1
    k = max(1, min(most, d, n - 1))
    if k < 2:
        return n, np.zeros(d), np.eye(d)
    mean = products[0, 1:] / n
    vectors = np.linalg.eigh(products[1:, 1:] - n * np.outer(mean, mean))[1][:, ::-1][:, :k]
    return n, mean, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def principal(rows: DataFrame, most: int) -> dict[int, Basis]:
    """The principal components of each group of rows (group int, u array<double>), widths equal within a group.

    One pass: every task adds up the products of its rows' columns, a square for each group, squares are added by
    group, and a task for each group turns its square into a basis. The driver gets a basis for each group. A group that fails has its error.
    """

    def products(batches):
        for batch in batches:
            for g, _, x in by_group(batch):
                x = np.hstack([np.ones((len(x), 1)), x])
                yield g, 0, x.T @ x

    def solve(batches):
        for batch in batches:
            for s in batch.to_pylist():
                n, mean, basis, error = 0, np.zeros(0), np.zeros(0), None
                try:
                    n, mean, basis = components(matrix(s["x"], s["height"]), most)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                numbers = [np.ascontiguousarray(x, "<f8").tobytes() for x in (mean, basis)]
                yield pa.record_batch([pa.array([s["p"]], pa.int32()), pa.array([n], pa.int64()), pa.array(numbers[:1]), pa.array(numbers[1:]), pa.array([error], pa.string())], ["g", "n", "mean", "basis", "error"])

    found = summed(rows, products).mapInArrow(solve, "g int, n long, mean binary, basis binary, error string").collect()
    return {r.g: Basis(r.n, np.frombuffer(r.mean), np.frombuffer(r.basis).reshape(len(r.mean) // 8, -1) if r.mean else np.zeros((0, 0)), r.error) for r in found}


def common_width(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is as wide as most rows' (ties: the narrower)."""
    sizes = rows.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by("width", F.struct("n", -F.col("width"))).alias("width")).first()
    return rows.where(F.size(vector) == (best.width if best and best.width is not None else -1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def project(rows: DataFrame, vector: str, found: Basis, out: str, unit: bool = False) -> DataFrame:
    """`rows` with their vectors (`unit`: scaled to length one), less the mean, in the components.

    The vector must not be an aggregate over an array (as `l2` is), which Spark does not plan as an Arrow function's argument.
    """
    held = rows.sparkSession.sparkContext.broadcast((found.mean, found.basis))  # one basis

    def place(v: pa.Array) -> pa.Array:
        mean, basis = held.value
        x = rows_of(v)
        return pa.array(list(((unit_rows(x) if unit else x) - mean) @ basis), pa.list_(pa.float64()))

    return rows.withColumn(out, F.arrow_udf(place, "array<double>")(F.col(vector)))


def pca_projection(docs: DataFrame, k: int = 2) -> DataFrame:
    """(doc_id, projected): centred principal components of all unit vectors.

    Documents without a usable vector (null, empty, not finite, no numbers), or with one of another width than most, get no row.
    """
    rows = common_width(docs.select("doc_id", usable_vector(docs, "embedding").alias("v")).where("v is not null"), "v")
    found = principal(rows.select(F.lit(0).alias("g"), l2(F.col("v")).alias("u")), k).get(0)
    if found is None:
        return rows.select("doc_id", F.col("v").alias("projected"))
    return project(rows, "v", found, "projected", unit=True).select("doc_id", "projected")
