"""Nearest neighbours on tables with repeated rows and unequal norms, against brute force."""

import numpy as np
import pytest


def test_repeats_of_one_id(spark):
    from rillmap.llm.ann import nearest

    rng = np.random.default_rng(6)
    x = [[float(v) for v in r] for r in rng.standard_normal((10, 4))]
    rows = [(k, v) for k, v in enumerate(x)] + [(20, x[0])] * 30 + [(21, x[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest(df, df.where("vec_id = 0")).collect()]
    assert {20, 21} <= set(got) and len(got) == len(set(got))


def by_force(rows, k=20, queries=lambda i: True):
    kept = [(i, np.array(v)) for i, v in rows]
    out = set()
    for i, q in kept:
        if queries(i):
            scored = sorted(((-float((v * q).sum()), j) for j, v in kept if j != i))[:k]
            out |= {(i, r + 1, j) for r, (_, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 21, 60])
def test_small_tables(spark, n):
    """All candidates if fewer, and the exact twenty where probes reach almost nothing."""
    from rillmap.llm.ann import nearest

    rng = np.random.default_rng(n)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(rng.standard_normal((n, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(df, df).collect()}
    want = by_force(rows)
    pairs = lambda found: {(q, v) for q, _, v in found}
    assert len(got) == len(want) and (n > 21 or got == want) and len(pairs(got) & pairs(want)) >= 0.9 * len(want)


@pytest.mark.parametrize("aim", [0.96, 2.0])
def test_unequal_norms(spark, aim, monkeypatch):
    """One long vector does not flatten the rest; an aim out of reach gives exact answers."""
    from rillmap.llm import ann

    monkeypatch.setattr(ann, "AIM", aim)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "GROUP", 100)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((800, 12)) * np.exp2(rng.integers(-3, 4, 800))[:, None]
    x[5] *= 1e6
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    want = {(q, v) for q, _, v in by_force(rows, queries=lambda i: i % 20 == 0)}
    assert len(got) == len(want) and len(got & want) >= (0.9 if aim < 1 else 1) * len(want)


def test_few_visits():
    """Where neighbours are near, a small share of the rows is visited."""
    from rillmap.llm.ann import band_of, fit

    rng = np.random.default_rng(3)
    x = (rng.standard_normal((100, 1, 16)) + 0.15 * rng.standard_normal((100, 40, 16))).reshape(-1, 16)
    rng.shuffle(x)
    norm = float(np.linalg.norm(x, axis=1).max())
    tables = fit(x, len(x), 20, norm, sorted(set(band_of(x, norm).tolist())))
    assert not tables.exact and tables.visited < 0.5


@pytest.mark.parametrize("aim", [0.96, 2.0])
def test_an_id_with_many_vectors_pushes_no_other_out(spark, aim, monkeypatch):
    """Thirty near vectors of one id, and thirty of the query's own, are one neighbour and none; an id counts by its nearest."""
    from rillmap.llm import ann

    monkeypatch.setattr(ann, "AIM", aim)
    monkeypatch.setattr(ann, "GROUP", 60)
    rng = np.random.default_rng(5)
    near = lambda spread: [float(v) for v in [1.0, 0, 0, 0] + spread * rng.standard_normal(4)]
    less = lambda spread: [0.9 * v / float(np.linalg.norm(w)) for w in [near(spread)] for v in w]
    rows = [(0, near(0.0)), *((20, near(0.01)) for _ in range(30)), *((0, near(0.02)) for _ in range(30)), *((k, less(0.3)) for k in range(100, 200)), *((k, less(0.5)) for k in range(100, 140))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id = 0").limit(1)
    query = np.array(asked.first().embedding)
    best = {}
    for i, v in rows:
        if i != 0:
            best[i] = max(best.get(i, -9.0), float((np.array(v) * query).sum()))
    want = sorted(((-s, i) for i, s in best.items()))[:20]
    found = ann.nearest(df, spark.createDataFrame([(0, query.tolist())], df.schema)).orderBy("rank").collect()
    assert len(found) == 20 and len({r.vec_id for r in found}) == 20 and found[0].vec_id == 20
    if aim > 1:
        assert [(r.vec_id, round(r.score, 12)) for r in found] == [(i, round(-s, 12)) for s, i in want]
    assert all(abs(r.score - best[r.vec_id]) < 1e-12 for r in found) or aim < 1
