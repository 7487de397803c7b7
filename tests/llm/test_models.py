"""The trained operators' arithmetic against plain reckonings: chains by enumeration, mixtures, Gaussians, the forest."""

from itertools import product

import numpy as np
import pytest


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def by_enumeration(score, trans):
    """Probability of state 1 at each place of one chain, over all its paths."""
    n, weight, total = len(score), np.zeros(len(score)), 0.0
    for path in product((0, 1), repeat=n):
        w = np.exp(sum(score[k] for k in range(n) if path[k]) + sum(trans[path[k], path[k + 1]] for k in range(n - 1)))
        total += w
        weight += w * np.array(path)
    return weight / total, np.log(total)


def test_marginals():
    from rillmap.llm.toxicity import marginals

    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 5, 9])
    score, trans = rng.standard_normal((4, 9)) * 2, rng.standard_normal((2, 2))
    p, _, log_z = marginals(score, lengths, trans)
    for k, n in enumerate(lengths):
        want, z = by_enumeration(score[k, :n], trans)
        assert np.allclose(p[k, :n], want) and np.isclose(log_z[k], z)


@pytest.mark.parametrize("stretch", [1, 3, 4, 128])
def test_stretches_make_no_difference(stretch, monkeypatch):
    """Marginals of whole texts, whatever the length of the stretches that are computed together."""
    from rillmap.llm import toxicity

    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    texts = ["one two three four five six seven eight nine ten", "", "alone", "a b", "x y z " * 4, " . "]
    tokens = toxicity.Tokens(*block(texts))
    model = toxicity.ChainField()
    rng = np.random.default_rng(1)
    model.weight = rng.standard_normal(len(model.weight))
    model.trans, model.bias = rng.standard_normal((2, 2)), -0.5
    got = model.probabilities(tokens)
    score = model.weight[tokens.features].sum(0) + model.bias
    for d in set(tokens.text.tolist()):
        mine = tokens.text == d
        assert np.allclose(got[mine], by_enumeration(score[mine], model.trans)[0])


def test_long_chain():
    from rillmap.llm import toxicity

    tokens = toxicity.Tokens(*block(["word " * 200_000]))
    model = toxicity.ChainField()
    model.trans = np.array([[0.5, -1.0], [-1.0, 0.7]])
    model.bias = 0.01
    p = model.probabilities(tokens)
    assert len(p) == 200_000 and np.isfinite(p).all() and np.ptp(p[1000:-1000]) < 1e-9


def test_spans(spark):
    from rillmap.llm.toxicity import score_toxicity

    clean = ["the garden lies by the river and the town", "a report on the long study of the old wood"]
    rows = [(k, f"{clean[k % 2]} part {k}" + (f" you filthy vermin scum {k}" if k % 4 == 0 else "")) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, label int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    for k, text in rows:
        assert (got[k].score >= 0.5) == (k % 4 == 0)
        said = [text.encode()[s.start : s.end].decode() for s in got[k].spans]
        assert all("vermin" in x or "filthy" in x or "scum" in x for x in said) and bool(said) == (k % 4 == 0)


def test_mixture_proportions():
    """Expectation-maximisation against a plain one, and sets of more than four languages."""
    from rillmap.llm.language import infer

    rng = np.random.default_rng(2)
    like = rng.standard_normal((40, 3)).astype(np.float32)
    like[:20, 0] += 3
    like[20:30, 1] += 3
    like[30:, :] += [0, 0, 6]
    heads = np.array([0, 30])
    lang, score = infer(like, heads, penalty=0.0)
    share = np.full(3, 1 / 3)
    for _ in range(200):
        r = share * np.exp(like[:30])
        share = (r / r.sum(1, keepdims=True)).mean(0)
    assert lang.tolist() == [0, 2] and abs(score[0] - share[0]) < 0.05 and score[1] > 0.9
    for k in (3, 4, 5, 7):  # a document in k languages of ten, the first of which has twice the words
        words = np.full((40 * (k + 1), 10), -20.0, np.float32)
        words[np.arange(len(words)), np.maximum(np.arange(len(words)) // 40 - 1, 0)] = -1.0
        lang, score = infer(words, np.array([0]))
        assert lang[0] == 0 and abs(score[0] - 2 / (k + 1)) < 0.02, k


def test_discriminant():
    """Log odds against dense Gaussian log densities, and covariances that shrink."""
    from rillmap.llm.quality import Discriminant

    rng = np.random.default_rng(3)
    x = [rng.standard_normal((n, 4)) @ rng.standard_normal((4, 4)) + m for n, m in ((500, 0.0), (60, 1.5))]
    stats = [len(v) for v in x], [v.sum(0) for v in x], [v.T @ v for v in x]
    shrink, floor = 0.1, 1e-3
    model = Discriminant(np.array(stats[0]), np.array(stats[1]), np.array(stats[2]), shrink, floor)
    pooled = sum(((v - v.mean(0)).T @ (v - v.mean(0))) for v in x) / 560
    scale = np.sqrt(np.diag(pooled))
    pooled = pooled / np.outer(scale, scale)
    want = []
    q = rng.standard_normal((20, 4)) * 2
    for v in x:
        own = np.cov(v.T, bias=True) / np.outer(scale, scale)
        a = len(v) * (1 - shrink) / (len(v) + 8)
        cov = a * own + (1 - a) * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + floor * np.eye(4)
        z = (q - v.mean(0)) / scale
        want.append(-0.5 * (np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.log_odds(q), want[1] - want[0] + np.log(61 / 501))


def test_forest(spark):
    """Trees on labelled findings: better than chance on held-out ones, and `fit` takes a table of them."""
    from rillmap.llm.secrets import Forest, describe, fit, invented_findings

    x, y = invented_findings(1200, seed=77)
    forest = Forest(x[:800], y[:800])
    said = forest.score(x[800:]) >= 0.5
    assert (said == y[800:]).mean() > 0.93
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        secret = k % 2
        value = "".join(rng.choice(list("abcdef0123456789"), 24)) if secret else f"build-{k}-release-notes"
        rows.append((value, "the token=" if secret else "see page ", " and more", secret))
    forest = fit(spark.createDataFrame(rows[:200], "value string, before string, after string, label int"))
    got = forest.score(np.array([describe(v, b, a) for v, b, a, _ in rows[200:]])) >= 0.5
    assert (got == np.array([r[3] for r in rows[200:]], bool)).mean() > 0.95
    assert fit(spark.createDataFrame([], "value string, before string, after string, label int")).score(x[:3]).shape == (3,)
