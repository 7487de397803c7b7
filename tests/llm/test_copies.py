"""Near copies of 0.8 similarity over five-word shingles, against brute force."""

import random
import re

import numpy as np
import pytest

from .test_exact import DOCS, awkward


def shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def rewritten():
    """Texts, their copies with a few words changed, and unlike texts that share a passage; then the awkward ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    shared, out = say(70), []
    for _ in range(30):
        base = say(rng.randint(120, 900))
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), len(copy) // 100):
                copy[at] = rng.choice(words)
            out.append("\n".join(copy).upper())
    out += [" ".join(say(80) + shared + say(80)) for _ in range(30)]
    rows = [(1000 + k, t, "en", "a", 0) for k, t in enumerate(out)]
    return rows + awkward()


def test_sketch():
    from rillmap.llm.simhash import WIDE, _sketch, sure_radius

    texts = [t for _, t, *_ in rewritten()]
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    count, prints, least = _sketch(np.frombuffer(b"".join(raw), np.uint8), off, 5)
    sets = [shingles(t) for t in texts]
    assert count.tolist() == [len(s) for s in sets]
    for i in range(0, len(texts), 5):
        alone = _sketch(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]), 5)
        assert (alone[1][0] == prints[i]).all() and (alone[2][0] == least[i]).all()
        for j in range(i):
            apart = int(np.bitwise_count(prints[i] ^ prints[j]).sum())
            s = similarity(sets[i], sets[j])
            assert (s == 1) == (apart == 0 and (least[i] == least[j]).all())
            if s >= 0.8:
                assert apart <= sure_radius(0.8)
            if s < 0.4 and count[i] > 50:
                assert apart > sure_radius(0.8)
    assert 0 < sure_radius(0.9) < sure_radius(0.8) < WIDE // 3


@pytest.mark.parametrize("tile", [8192, 2])
def test_near_copies(spark, tile, monkeypatch):
    from rillmap.llm import simhash

    monkeypatch.setattr(simhash, "TILE", tile)
    rows = rewritten()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = simhash.near_copies(docs).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    sets = [shingles(t) for _, t, *_ in rows]
    for i, (a, *_) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if None not in (a, b) and 7 not in (a, b):
                s = similarity(sets[i], sets[j])
                if s >= 0.85 or s == 1:
                    assert of[a] == of[b], (a, b, s)
                if a >= 1120 or b >= 1120:  # texts that only share a passage
                    assert a == b or of[a] != of[b]
    kept = [r for r in simhash.drop_copies(docs.withColumn("kept", docs.source).withColumn("component_id", docs.lang)).collect()]
    # the two texts of id 7 are two groups
    ids = sorted(r.doc_id for r in kept)
    assert ids == sorted([*{r.component_id for r in got}, 7])


def test_no_rows(spark):
    from rillmap.llm.simhash import drop_copies

    assert drop_copies(spark.createDataFrame([], DOCS)).count() == 0
    assert drop_copies(spark.createDataFrame([(None, None, None, None, None)] * 2 + [(3, " ", None, None, None)], DOCS)).collect()[0].doc_id == 3


@pytest.mark.parametrize("tile", [8192, 2])
def test_links_are_exact(spark, tile, monkeypatch):
    """Pairs from 0.75 to 0.85, and texts of 5 to 20 words beside longer ones that hold them."""
    from rillmap.llm import simhash

    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n)]
    pairs = []
    for n in range(5, 21):
        for more in range(1, 6):
            base = say(n)
            pairs.append((base, base + say(more)))
    for _ in range(60):
        base = say(rng.randint(100, 400))
        keep = int(rng.uniform(0.75, 0.85) * (len(base) - 4)) + 4
        pairs.append((base[:keep], base))
    rows = [(k, " ".join(t), "en", "a", 0) for k, t in enumerate(x for pair in pairs for x in pair)]
    of = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    linked = 0
    for k in range(0, len(rows), 2):
        s = similarity(shingles(rows[k][1]), shingles(rows[k + 1][1]))
        assert (of[k] == of[k + 1]) == (s >= 0.8 - 1e-9), (rows[k], s)
        linked += s >= 0.8 - 1e-9
    assert 20 < linked < len(pairs) - 20


def test_many_near_equal_sketches_hold_no_pairs():
    """8192 sketches that all lie near each other are one group in little memory, though they make 33 million pairs."""
    import tracemalloc

    from rillmap.llm.simhash import WIDE, _similar, _united, close_parts

    rng = np.random.default_rng(0)
    bits = np.repeat(rng.integers(0, 2, (2, WIDE), dtype=np.uint8), 4096, 0)
    bits[np.arange(8192), rng.integers(0, WIDE, 8192)] ^= 1
    prints = np.packbits(bits, axis=1)
    tracemalloc.start()
    label = _united(8192, close_parts(prints, 200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(label[:4096]) == {0} and set(label[4096:]) == {4096} and peak < 400e6, peak
    sets = [np.array([1, 2, 3, 4, k % 3 + 10], np.uint64) for k in range(40)] + [np.array([7], np.uint64), np.zeros(0, np.uint64)]
    every = [(np.array([i]), np.array([j])) for i in range(42) for j in range(i + 1, 42)]
    for similarity, groups in ((0.6, 3), (0.9, 5)):
        label = _similar(sets, iter(every), similarity)
        assert len(set(label.tolist())) == groups and all(label[k] <= k for k in range(42))


def test_parts_are_the_pairs(monkeypatch):
    from rillmap.llm import simhash

    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(int(fps[i] ^ fps[j])).count("1") <= 2}
    for size in (1 << 22, 1 << 7):
        monkeypatch.setattr(simhash, "STEP_PAIRS", size)
        assert {*zip(*(x.tolist() for x in simhash.close_pairs(fps, 2, block=128)), strict=True)} == want
