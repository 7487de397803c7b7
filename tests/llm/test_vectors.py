"""Near-duplicate vectors where ids are absent or repeated, against brute force over the rows."""

import math

import numpy as np
import pytest


def by_force(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) of each row; rows are nodes, ids only name them."""
    unit = [None if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in links[j] if k not in seen and not seen.add(k)]
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


@pytest.mark.parametrize("cell", [16384, 3])
def test_absent_and_repeated_ids(spark, cell, monkeypatch):
    from rillmap.llm import embedding_dedup as m

    monkeypatch.setattr(m, "CELL", cell)
    monkeypatch.setattr(m, "BLOCK", max(2, cell))
    one, two, three = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, one), (None, [1.0, 0.01, 0.0]), (2, two), (None, [0.0, 1.0, 0.01])]  # two groups, each with a copy without an id
    rows += [(None, three), (None, [0.01, 0.0, 1.0]), (None, three)]  # a group without any id
    rows += [(7, [-1.0, 0.0, 0.0]), (7, [0.0, -1.0, 0.0]), (8, [-1.0, 0.01, 0.0]), (9, [0.0, -1.0, 0.01])]  # one id, two vectors
    rows += [(20, None), (None, None), (21, [0.0] * 3), (22, [1.0, None, 0.0]), (23, [float("inf"), 0.0, 0.0]), (24, []), (20, one), (25, [1.0, 0.0])]
    rng = np.random.default_rng(2)
    rows += [(100 + k // 2 if k % 5 else None, [float(x) for x in v]) for k, v in enumerate(np.repeat(rng.standard_normal((12, 3)), 3, 0) + 0.1 * rng.standard_normal((36, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in m.near_duplicate_vectors(df).collect()), key=key) == sorted(by_force(rows), key=key)


def test_one_pivot_where_cells_copy_more(spark, monkeypatch):
    """On random directions cells would copy every vector more often than blocks do; the links are the same either way."""
    from rillmap.llm import embedding_dedup as m

    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 24))
    x[200:] = x[:100] + 0.05 * rng.standard_normal((100, 24))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    monkeypatch.setattr(m, "CELL", 20)
    want = sorted(by_force(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (100, 10):
        monkeypatch.setattr(m, "BLOCK", block)
        assert sorted(tuple(r) for r in m.near_duplicate_vectors(df).collect()) == want


def test_near_pairs_are_judged_in_small_steps():
    """3000 near equal vectors make 4.5 million pairs, which are all found without being held as vectors at once."""
    import tracemalloc

    from rillmap.llm import embedding_dedup as m

    rng = np.random.default_rng(3)
    x = rng.standard_normal(64) + 0.01 * rng.standard_normal((3000, 64))
    home, far = np.ones(3000, bool), np.zeros(3000)
    for block, want in ((None, 3000 * 2999 // 2), (np.arange(3000) < 1000, 1000 * 2000)):
        tracemalloc.start()
        found = sum(len(i) for i, _ in m.join_cell(x, home, far, block, 0.95))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == want and peak < 150e6, (found, peak)


@pytest.mark.parametrize("blocks", [1, 2])
def test_leading_directions_lose_no_pair(blocks):
    from rillmap.llm import embedding_dedup as m

    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x[1000:] = x[:500] + rng.uniform(0.02, 0.06, (500, 1)) * 8 * rng.standard_normal((500, 64))
    x = x.astype(np.float32)
    unit = m.unit(x.astype(float))
    axes = m.leading(unit, 0.95)
    assert axes.shape[0] == 64 and axes.shape[1] < 40
    block = None if blocks == 1 else rng.random(1500) < 0.4
    near = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    want = {(i, j) for i, j in near.tolist() if block is None or block[i] != block[j]}
    far = np.arccos(np.clip(unit @ unit[0], -1, 1))
    got = [(min(p), max(p)) for i, j in m.join_cell(x, np.ones(1500, bool), far, block, 0.95, axes) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
