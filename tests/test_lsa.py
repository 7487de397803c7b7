"""The block decomposition against NumPy's full one, and tiled matches against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmap.operators import lsa
from rillmap.operators.lsa import best_matches, latent_centroids, latent_rows
from rillmap.operators.transitions import lsa_transitions, pair_weights


def papers(spark, per_year=26, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("graph", "cell", "light", "sound", "metal") for b in ("node", "wave", "field", "test")]
    rows = [(y * 1000 + d, y, d % 4, " ".join(rng.choices(vocabulary[4 * (d % 4) : 4 * (d % 4) + 6], k=rng.randrange(3, 9)))) for y in (1999, 2001, 2002) for d in range(per_year)]
    rows += [(9, 1999, 0, None), (9, 2001, 1, ""), (10, None, 1, "graphnode")]
    return spark.createDataFrame(rows, "doc_id int, year int, cluster_id int, title string")


def plain(pairs, most):
    """Cosines of cluster means in the truncated space, by NumPy's decomposition of the whole matrix."""
    rows = [r for r in pairs.w.collect()]
    out = {}
    for p in {r.year_from for r in rows}:
        own = [r for r in rows if r.year_from == p]
        docs, terms = (sorted({k(r) for r in own}) for k in (lambda r: (r.side, r.doc_id, r.cluster_id), lambda r: r.term))
        x = np.zeros((len(docs), len(terms)))
        for r in own:
            x[docs.index((r.side, r.doc_id, r.cluster_id)), terms.index(r.term)] = r.w
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        k = min(most, max(2, min(len(terms), pairs.sizes[p]) - 1), len(docs), len(terms))
        z = u[:, :k] * s[:k]
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        mean = {g: z[[(d[0], d[2]) == g for d in docs]].mean(0) for g in {(d[0], d[2]) for d in docs}}
        unit = {g: v / np.linalg.norm(v) for g, v in mean.items()}
        for (side, a), v in unit.items():
            if side == 0:
                out[p, a] = {b: float(v @ w) for (other, b), w in unit.items() if other == 1}
    return out


@pytest.mark.parametrize("most,tolerance", [(256, 1e-6), (5, 3e-2)])
def test_cosines_equal_the_full_decomposition(spark, monkeypatch, most, tolerance):
    monkeypatch.setattr(lsa, "ROWS", 16)
    monkeypatch.setattr(lsa, "COLUMNS", 32)
    docs = papers(spark)
    want = plain(pair_weights(docs, F.col("title")), most)
    got = lsa_transitions(docs, F.col("title"), 0.08, most).collect()
    assert {(r.year_from, r.prev_id) for r in got} == set(want) and {r.year_to for r in got} == {2001, 2002}
    for r in got:
        best = max(want[r.year_from, r.prev_id].values())
        assert r.matched == (best >= 0.08)
        if r.matched:
            assert abs(r.similarity - best) < tolerance and abs(want[r.year_from, r.prev_id][r.next_id] - best) < tolerance


def test_rows_span_the_matrix_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.random((50, 12)) * (rng.random((50, 12)) < 0.4)) @ rng.random((12, 30))
    rows = [(p, f"d{i}", f"t{j}", float((p + 1) * x[i, j])) for p in (0, 7) for i in range(50) for j in range(30)]
    w = spark.createDataFrame(rows, "p int, doc string, term string, w double")
    monkeypatch.setattr(lsa, "ROWS", 9)
    monkeypatch.setattr(lsa, "COLUMNS", 9)
    docs, blocks = latent_rows(w, {0: 50, 7: 50}, most=40)
    own = {(r.p, r.b): np.frombuffer(r.x).reshape(r.height, -1) for r in blocks.collect()}
    z = {(r.p, r.doc): own[r.p, r.i][r.r] for r in docs.collect()}
    for p in (0, 7):
        m = np.array([z[p, f"d{i}"] for i in range(50)])
        assert np.allclose(m @ m.T, (p + 1) ** 2 * (x @ x.T), atol=1e-8)


def test_nothing_is_dealt_for_each_term(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.zeros((60, 2040))
    x[:, :40] = rng.random((60, 9)) @ rng.random((9, 40))
    for d in range(4):  # terms of one document alone, so that the rank is 13
        x[d, 40 + 500 * d : 540 + 500 * d] = rng.random(500) / 4
    rows = [(0, f"d{i}", f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    dealt, own = [], lsa.cut

    def watched(df):
        df = own(df)
        if "x" in df.columns:
            dealt.append(df.agg(F.sum(F.length("x"))).first()[0])
        return df

    monkeypatch.setattr(lsa, "cut", watched)
    for name, size in (("ROWS", 16), ("COLUMNS", 7), ("SLICE", 4)):
        monkeypatch.setattr(lsa, name, size, raising=False)
    docs, blocks = latent_rows(spark.createDataFrame(rows, "p int, doc string, term string, w double"), {0: 60}, most=5)
    found = {r.b: np.frombuffer(r.x).reshape(r.height, -1) for r in blocks.collect()}
    z = {r.doc: found[r.i][r.r] for r in docs.collect()}
    m = np.array([z[f"d{i}"] for i in range(60)])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    best = u[:, :5] * s[:5]
    assert np.allclose(m @ m.T, best @ best.T, atol=1e-8)
    assert max(dealt) < 50_000  # 21 numbers for each of 60 documents and some small squares; with rows for 2040 terms they were 212160 bytes


def test_centroids_of_rows(spark):
    rows = [(1, f"d{i}", f"t{j}", 1.0 if i % 3 == j else 0.5) for i in range(9) for j in range(3)]
    docs, blocks = latent_rows(spark.createDataFrame(rows, "p int, doc string, term string, w double"), {1: 9}, most=10)
    labels = spark.createDataFrame([(1, f"d{i}", i % 2, i % 3) for i in range(9)], "p int, doc string, side int, cluster int")
    found = latent_centroids(docs, blocks, labels).collect()
    assert {(r.side, r.cluster): r.n for r in found} == {(s, c): sum(i % 2 == s and i % 3 == c for i in range(9)) for s in (0, 1) for c in range(3)}
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-9 for r in found)


@pytest.mark.parametrize("tile", [2, 5, 512])
def test_tiles_find_the_best_of_all_pairs(spark, tile):
    rng = np.random.default_rng(tile)
    sides = [[(p, i, [float(v) for v in rng.integers(-2, 3, 3)]) for p in (1, 2) for i in range(n)] for n in (17, 11)]
    a, b = (spark.createDataFrame(s, "p int, id int, vector array<double>") for s in sides)
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    for r in best_matches(a, b, tile).collect():
        own = next(v for p, i, v in sides[0] if (p, i) == (r.p, r.prev_id))
        near = sorted((-round(float(unit(own) @ unit(v)), 9), i) for p, i, v in sides[1] if p == r.p)
        assert (r.next_id, r.similarity) == (near[0][1], -near[0][0])
    assert best_matches(a, b, tile).count() == 34
