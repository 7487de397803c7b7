"""Packing by tiers: ids against the tokenizer, plans by their rules, and whole tables piece by piece."""

import random
import zlib

import numpy as np
import pytest

from .test_exact import DOCS, awkward

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    from rillmap.llm.queries import tokenizer_path

    return tokenizer_path()


def ids_of(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_ids(path, monkeypatch):
    from rillmap.llm import packing

    model = packing._Encoder(path)
    assert model.ranked is not None
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 13, *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC, 0x6771, 0x1F642, 0xA0, 0x2029]] + [" "] * 60 + ["\n"] * 8 + ["'s", "'ll", "'S", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t for _, t, *_ in awkward() if t]
    texts += [" " * 1_500_000 + "x", "a" * 300_000, "\n\n" * 70_000, "two  spaces " * 2000]
    whole = tokenizers.Tokenizer.from_file(path)
    for t in texts:
        assert model.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]
    monkeypatch.setattr(packing, "SLICE", 50)
    for t in texts[:-4]:
        assert model.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]


@pytest.mark.parametrize("change", [("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "Lowercase"})])
def test_other_files_are_taken_as_they_are(path, tmp_path, change):
    import json

    from rillmap.llm.packing import _Encoder

    said = json.load(open(path, encoding="utf-8")) | dict([change])
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said), encoding="utf-8")
    model, text = _Encoder(str(other)), "The Cat's 12 HATS, and more."
    assert model.ranked is None and np.frombuffer(model.encode(text), "<u4").tolist() == ids_of(str(other), text) != ids_of(path, text)


@pytest.mark.parametrize("smallest", [16, 64, 256])
def test_plan(smallest):
    from rillmap.llm.packing import plan, tier_sizes

    rng = random.Random(smallest)
    lengths = [rng.choice([1, rng.randint(1, 30), rng.randint(1, 300), rng.randint(1, 900)]) for _ in range(1000)] + [rng.randint(1, 128) for _ in range(4000)]
    full, rest = plan(lengths, 256, smallest)
    covered = sorted(p for _, pieces in [*full, (0, rest)] for p in pieces)
    at = [0] * len(lengths)
    for d, start, n in covered:  # without a gap
        assert start == at[d] and n > 0
        at[d] += n
    assert at == lengths and sum(p[2] for p in rest) < 256
    sizes = tier_sizes(256, smallest)
    below = dict(zip(sizes, [*sizes[1:], 0], strict=True))
    for size, pieces in full:
        assert sum(p[2] for p in pieces) == size and below[size] < pieces[0][2] <= size  # its own tier opens it
    assert {s for s, _ in full} == set(sizes)


def test_tiers_change_the_plan():
    from rillmap.llm.packing import plan

    lengths = [20] * 64
    assert {s for s, _ in plan(lengths, 256, 32)[0]} == {32} and {s for s, _ in plan(lengths, 256, 256)[0]} == {256}


@pytest.mark.parametrize("block_tokens", [1 << 22, 200])
def test_pack(spark, path, block_tokens):
    from rillmap.llm.packing import pack

    docs = spark.createDataFrame(awkward(), DOCS).repartition(3)
    rows = pack(docs, path, window=256, smallest=16, block_tokens=block_tokens, per_group=4).collect()
    want = [(d, [*ids_of(path, x), 1]) for d, x, *_ in awkward()]
    pieces, by = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        by.setdefault(r.sequence_id, []).append(r)
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    for key in {(d, len(v)) for d, v in want}:
        # repeated rows are cut each for itself, so their pieces are told apart by where they go on
        left, texts = sorted(pieces.pop(key)), [v for d, v in want if (d, len(v)) == key]
        assert sum(p[1] for p in left) == sum(map(len, texts))
        assert all(any(crc(v[s : s + n]) == c for v in texts) for s, n, c in left)
        assert sorted(s for s, *_ in left if s) == sorted(s + n for s, n, _ in left if s + n < key[1])
    assert not pieces
    unfilled, costs = 0, {}
    for group in by.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= group[0].tier <= 256
        if at < group[0].tier:
            assert group[0].tier == 256
            unfilled += 1
        assert len({p.step_group for p in group}) == 1
        costs.setdefault(group[0].step_group, []).append(sum(p.length**2 for p in group))
    assert unfilled <= (1 if block_tokens > 200 else 2 + sum(r.length for r in rows) // 200)
    assert sorted(by) == list(range(len(by))) and max(map(len, costs.values())) <= 4
    ranked = sorted(costs.values(), key=sum)
    assert sum(ranked[-1]) - sum(ranked[0]) <= max(max(c) for c in ranked)


def test_long_text_and_copies(spark, path):
    from rillmap.llm.packing import pack

    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(500_000))
    rows = pack(spark.createDataFrame([(1, long), (2, "same words"), (2, "same words"), (None, None), (3, "")], "doc_id long, text string"), path).collect()
    ids = [*ids_of(path, long), 1]
    at = 0
    for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
        at += r.length
    assert at == len(ids) and sum(r.length for r in rows) == len(ids) + 2 * (len(ids_of(path, "same words")) + 1) + 2
