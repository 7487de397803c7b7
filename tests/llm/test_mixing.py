"""Mixtures of overlapping sources: the routing reaches the documents, against a linear reckoning of the plan."""

import random

import pytest

SCHEMA = "doc_id long, text string, source string, tags array<string>"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["word"] * rng.randint(1, 30)), None, rng.choice([["a"], ["a"], ["a", "b"], ["b"], ["b", "c"], ["c"]])) for k in range(3000)]
    rows += [(None, "same text " * 5, None, ["a"])] * 300 + [(9000, "x y z", None, ["b"])] * 5 + [(9001, None, None, ["c"]), (9002, " ", None, ["c"])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 1, 8), (1, 0, 0)])
def test_overlap(docs, weights):
    from rillmap.llm.mixing import mix, mix_sources

    rows = mix_sources(docs, weights=weights, sources="tags").collect()
    assert len(rows) == docs.count()
    size, credit, total = {}, {}, sum(r["size"] for r in rows)
    for r in rows:
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 2 * r["size"]
        assert sum(c.taken for c in r.credited) == r.taken and {c.source for c in r.credited if c.taken} <= set(r.pattern)
        for s in r.pattern:
            size[s] = size.get(s, 0) + r["size"]
        for c in r.credited:
            credit[c.source] = credit.get(c.source, 0) + c.taken
    # targets by weight, none above twice its source, the excess reshared
    left, target, open_ = 1.5 * total, {}, dict(zip("abc", weights, strict=True))
    while open_ and sum(open_.values()):
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if unit * w > 2 * size[s]]
        if not full:
            target |= {s: unit * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
            del open_[s]
    reachable = sum(2 * r["size"] for r in rows)
    if weights == (5, 2, 1):  # every quota can be met through the shared documents
        assert sum(target.values()) <= reachable
        for s in "abc":
            assert abs(credit[s] - target[s]) <= 0.01 * total, (s, credit, target)
    assert all(credit.get(s, 0) <= target.get(s, 0) + 0.01 * total for s in "abc")
    copies = {}
    for r in mix(docs, weights=weights, sources="tags").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in rows:
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert copies == want
    assert sorted(map(str, mix_sources(docs, weights=weights, sources="tags").collect())) == sorted(map(str, rows))


def test_small_bins(docs, monkeypatch):
    """Places inside bins of few documents, and a group of repeated rows that is divided."""
    from rillmap.llm import mixing

    monkeypatch.setattr(mixing, "BIN_ROWS", 2)
    monkeypatch.setattr(mixing, "BINS", 3)
    rows = mixing.mix_sources(docs.where("doc_id is null or doc_id < 50"), sources="array('s')").collect()
    total = sum(r["size"] for r in rows)
    assert -0.5 <= 1.5 * total - sum(r.taken for r in rows) < 30
    only = docs.where("doc_id is null")
    assert sum(r.taken for r in mixing.mix_sources(only, sources="tags").collect()) == 4500 == 10 * mixing.mix(only, sources="tags").count()
