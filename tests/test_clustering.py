"""Clusters and components against NumPy."""

import numpy as np
import pytest


def vectors(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((2, 4, 12)) * 3
    rows = [(k, 2000 + k % 2, [float(v) for v in middle[k % 2, (k // 2) % 4] + 0.2 * rng.standard_normal(12)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, year int, embedding array<float>").repartition(3)


@pytest.mark.parametrize("part_rows", [50_000, 25])
def test_k_means(spark, part_rows, monkeypatch):
    """The planted groups whether a year goes whole or in mini-batches; clusters are numbered by size and smallest id."""
    from rillmap.operators import clustering

    monkeypatch.setattr(clustering, "PART_ROWS", part_rows)
    rows, df = vectors(spark)
    got = {r.doc_id: (r.year, r.cluster_id) for r in clustering.cluster_years(df, 4, dims=5).collect()}
    assert len(got) == len(rows)
    for year in (2000, 2001):
        mine = [r for r in rows if r[1] == year]
        labels = np.array([got[r[0]][1] for r in mine])
        truth = np.array([(r[0] // 2) % 4 for r in mine])
        assert len({*zip(labels.tolist(), truth.tolist(), strict=True)}) == 4  # the planted groups, renamed
        first = [min(r[0] for r, x in zip(mine, labels, strict=True) if x == c) for c in range(4)]
        assert first == sorted(first)  # equal sizes: numbered by smallest id


def inertia(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels.tolist()))


@pytest.mark.parametrize("part_rows", [50_000, 100])
def test_inertia_is_that_of_plain_k_means(spark, part_rows, monkeypatch):
    """On groups of unequal size, within 2 percent of plain rounds that start from the planted middles."""
    from rillmap.operators import clustering

    monkeypatch.setattr(clustering, "PART_ROWS", part_rows)
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((12, 16))
    which = np.minimum(rng.geometric(0.2, 1500) - 1, 11)
    x = middle[which] + 0.25 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(k, 2000, v) for k, v in enumerate(x.tolist())], "doc_id long, year int, embedding array<double>").repartition(4)
    labels = np.array([r.cluster_id for r in clustering.cluster_years(df, 12, dims=16).orderBy("doc_id").collect()])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    c = np.array([unit[which == j].mean(0) for j in range(12)])
    for _ in range(50):
        own = ((unit[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([unit[own == j].mean(0) for j in range(12)])
    assert inertia(unit, labels) <= 1.02 * inertia(unit, own)
    again = np.array([r.cluster_id for r in clustering.cluster_years(df.repartition(7), 12, dims=16).orderBy("doc_id").collect()])
    assert (again == labels).all()  # no matter how the rows lie


def test_years_are_reported(spark, monkeypatch):
    """A year that fails loses its own documents, with its reason; repeated ids stay as many as they are."""
    from rillmap.operators import clustering, pca

    good = [(k % 4, y, [float(k % 2), 1.0 - k % 2, 0.5]) for y in (2000, 2001) for k in range(8)]
    bad = [(20, 2000, None), (21, 2000, [1.0]), (22, 1990, None), (23, None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "doc_id long, year int, embedding array<double>")
    found = clustering.fit_years(df, 2)
    assert sorted(map(tuple, found.report.collect())) == [(1990, "unusable vector", 1), (2000, "clustered", 8), (2000, "other width", 1), (2000, "unusable vector", 1), (2001, "clustered", 8)]
    assert found.docs.count() == 16 and found.docs.columns == ["doc_id", "year", "embedding", "cluster_id"]
    with pytest.raises(ValueError, match="2000: 1 documents with other width"):
        clustering.fit_years(df, 2, on_bad="fail")
    real = clustering.principal

    def failing(rows, most):
        found = real(rows, most)
        found[2001] = pca.Basis(8, np.zeros(3), np.zeros((3, 2)), "LinAlgError: no luck")
        return found

    monkeypatch.setattr(clustering, "principal", failing)
    found = clustering.fit_years(df, 2)
    assert {r.year for r in found.docs.collect()} == {2000} and (2001, "error: LinAlgError: no luck", 8) in set(map(tuple, found.report.collect()))


@pytest.mark.parametrize("most", [3, 50])
def test_components_of_every_group(spark, most):
    """Each group's components are NumPy's over all its rows; a lone row has the identity."""
    from rillmap.operators.pca import principal

    rng = np.random.default_rng(most)
    groups = {g: rng.standard_normal((n, 6)) * [5, 4, 3, 2, 1, 0.5] + g for g, n in ((1, 400), (-2, 5), (7, 1))}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x.tolist()], "g int, u array<double>").repartition(3)
    for g, b in principal(df, most).items():
        x, k = groups[g], max(1, min(most, 6, len(groups[g]) - 1))
        if k < 2:
            assert np.allclose(b.basis, np.eye(6)) and b.n == 1
            continue
        want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:k].T
        assert b.n == len(x) and np.allclose(b.mean, x.mean(0)) and np.allclose(np.abs(b.basis.T @ want), np.eye(k), atol=1e-6)


def test_components_group_what_lies_together(spark):
    """Planted groups of centroids are found, numbered by size; one centroid, or none, is a group of its own, or none."""
    from rillmap.operators.components import ComponentConfig, centroids, group_components, reduce_dimensions

    rng = np.random.default_rng(4)
    middle = rng.standard_normal((3, 10)) * 2
    rows = [(y * 100 + c * 10 + d, y, c, (middle[min(c // 2, 2)] + 0.05 * rng.standard_normal(10)).tolist()) for y in (2000, 2001, 2003) for c in range(8) for d in range(5)]
    rows += [(9000, 2000, 0, None), (9001, 2000, 0, [1.0]), (9002, 2001, 1, [float("nan")] * 10), (9003, 2001, None, [1.0] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, year int, cluster_id int, embedding array<double>")
    cents = centroids(df).orderBy("year", "cluster_id").collect()
    assert len(cents) == 24 and all(r.docs == 5 for r in cents)
    for r in cents:
        unit = np.array([v for _, y, c, v in rows if (y, c) == (r.year, r.cluster_id) and v and len(v) == 10 and not np.isnan(v).any()])
        mean = (unit / np.linalg.norm(unit, axis=1)[:, None]).mean(0)
        assert np.allclose(r.vector, mean / (np.linalg.norm(mean) + 1e-12))
    docs, meta = group_components(df, ComponentConfig(n_components=3, pca_dims=4))
    assert {(r.cluster_id // 2 if r.cluster_id < 4 else 2, r.component_tech_id) for r in meta.collect()} == {(0, 1), (1, 2), (2, 0)}
    assert docs.count() == len(rows) and {r.component_tech_id for r in docs.where("orig_cluster_id = 7").collect()} == {0}
    x = np.array([r.vector for r in cents])
    z = np.array([r.z for r in reduce_dimensions(centroids(df), ComponentConfig(pca_dims=4)).orderBy("year", "cluster_id").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:4].T
    assert np.allclose(np.abs(z), np.abs(want / np.linalg.norm(want, axis=1)[:, None]), atol=1e-6)
    for some, n in ((df.where("year = 2000 and cluster_id = 1"), 1), (df.where("false"), 0)):
        docs, meta = group_components(some)
        assert [r.component_tech_id for r in meta.collect()] == [0] * n and docs.count() == 5 * n


def test_titles_of_rows_with_bad_vectors(spark):
    from rillmap.operators.components import representative_titles

    rows = [(1, 2000, 0, "a", [1.0, 0.0]), (2, 2000, 0, "b", [1.0, 0.1]), (3, 2000, 0, "c", None), (4, 2000, 0, "d", [1.0]), (5, 2000, 0, "e", [None, 1.0]), (6, 2001, 0, "f", [0.0, 1.0])]
    found = representative_titles(spark.createDataFrame(rows, "doc_id long, year int, cluster_id int, title string, embedding array<double>"))
    assert {(r.year, r.title) for r in found.collect()} == {(2000, "a"), (2000, "b"), (2001, "f")}


def test_vocabulary_backs_off(spark):
    """Where pruning would leave a year no term it keeps all of them, and a year that keeps some keeps only those."""
    from pyspark.sql import functions as F

    from rillmap.operators.tfidf import cluster_terms

    rows = [(k, 2000, 0, f"alone{k}a alone{k}b") for k in range(25)] + [(100 + k, 2001, 0, f"shared word{k}" if k % 2 else f"word{k}") for k in range(30)]
    found = cluster_terms(spark.createDataFrame(rows, "doc_id long, year int, cluster_id int, title string"), F.col("title")).collect()
    assert len([r for r in found if r.year == 2000]) == 30 and {r.term for r in found if r.year == 2001} == {"shared"}


def test_one_document_and_none(spark):
    from rillmap.operators.clustering import cluster_years

    schema = "doc_id long, year int, embedding array<float>"
    assert [tuple(r) for r in cluster_years(spark.createDataFrame([(5, 1999, [1.0, 0.0])], schema), 3).collect()] == [(5, 1999, 0)]
    assert cluster_years(spark.createDataFrame([], schema), 3).count() == 0


def test_principal_components(spark):
    from rillmap.operators.pca import pca_projection

    rows, df = vectors(spark, 1, 100)
    x = np.array([r[2] for r in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    got = np.array([r.projected for r in pca_projection(df).orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_bad_vectors_get_no_cluster(spark):
    """Nulls, other widths and components that are no finite numbers fail nothing, in arrays and in text."""
    from rillmap.operators.clustering import cluster_years

    good = [(k, 2000, [float(k % 2), 1.0 - k % 2]) for k in range(6)]
    bad = [(10, 2000, [1.0, None]), (11, 2000, [1.0, float("nan")]), (12, 2000, [1.0, 2.0, 3.0]), (13, 2000, []), (14, 2000, None), (15, None, [1.0, 0.0]), (16, 2000, [float("inf"), 0.0])]
    got = {r.doc_id: r.cluster_id for r in cluster_years(spark.createDataFrame(good + bad, "doc_id long, year int, embedding array<double>"), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1}
    text = [(k, y, None if v is None else str(v)) for k, y, v in good + [b for b in bad if b[0] != 11 and b[0] != 16]]
    assert {r.doc_id: r.cluster_id for r in cluster_years(spark.createDataFrame(text, "doc_id long, year int, embedding string"), 2).collect()} == got


def test_unit_vectors(spark):
    from pyspark.sql import functions as F

    from rillmap.functions.vectors import l2

    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None])]
    got = {r.k: r.u for r in spark.createDataFrame(rows, "k int, v array<float>").select("k", l2(F.col("v")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [], 5: [1.0, None]}
