"""Sums of dense blocks of numbers, keyed by a scope and a block number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of sums that a task holds before it deals them.
HELD = 64 << 20


def matrix(raw: bytes, height: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(height, -1)


DENSE = "p int, b int, height int, x binary"


def record(p: int, b: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array([v], pa.int32()) for v in (p, b, len(x))), pa.array([np.ascontiguousarray(x, "<f8").tobytes()])], ["p", "b", "height", "x"])


def summed(parts: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """Dense blocks (p, b, height, x), the sums of the blocks that `make` yields: first within each task, then over all.

    A task holds HELD bytes of sums before it deals them; what is dealt is added up as it comes, a block at a time.
    """

    def within(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for p, b, x in make(batches):
            if (p, b) in total:
                total[p, b] += x
            else:
                total[p, b] = x
                size += x.nbytes
            if size > HELD:
                yield from (record(*k, v) for k, v in total.items())
                total, size = {}, 0
        yield from (record(*k, v) for k, v in total.items())

    def over(batches):
        own, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                x = matrix(batch.column(3)[k].as_py(), batch.column(2)[k].as_py())
                if key == own:
                    total += x
                else:
                    if own:
                        yield record(*own, total)
                    own, total = key, x.copy()
        if own:
            yield record(*own, total)

    return parts.mapInArrow(within, DENSE).repartition("p", "b").sortWithinPartitions("p", "b").mapInArrow(over, DENSE)
