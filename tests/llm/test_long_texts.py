"""Texts longer than the blocks, stretches and steps that the operators take at once."""

import hashlib

import numpy as np
import xxhash

LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)


def test_substrings_across_stretches(spark):
    """A text of 13 MiB with planted copies: over the border of its stretches, overlapping itself, from another text."""
    from rillmap.llm.substring_dedup import remove_repeats

    rng = np.random.default_rng(4)
    long, other = (rng.choice(LETTERS, n) for n in (13 << 20, 4000))
    copies = [(1_000_000, (12 << 20) - 250, 500), (2_000_000, (12 << 20) + 5000, 100), (3_000_000, 12_000_000, 2_000), (4_000_000, 9_000_000, 99)]
    for source, target, n in copies:
        long[target : target + n] = long[source : source + n]
        for side in (-1, n):  # no longer by chance
            long[target + side] = 48 if long[source + side] != 48 else 49
    other[100:1100] = long[(12 << 20) - 1000 : 12 << 20]
    other[99], other[1100] = 50, 51
    rows = [(1, long.tobytes().decode()), (2, other.tobytes().decode())]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    gone = np.zeros(len(long), bool)
    for _, target, n in copies[:3]:
        gone[target : target + n] = True
    left = np.concatenate([other[:100], other[1100:]])
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (13 << 20, 2600, 3)
    assert got[1].kept_sha256 == hashlib.sha256(long[~gone].tobytes()).hexdigest()
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (1000, 1, hashlib.sha256(left.tobytes()).hexdigest())


def test_fingerprint_of_many_shingles():
    from rillmap.llm.simhash import SEED, _fingerprint

    rng = np.random.default_rng(5)
    for n in (65536 + 1, 65536 + 2, 150_000):
        words = [f"W{k}" for k in rng.integers(0, 5000, n)]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).lower(), SEED) for k in range(n - 2)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert _fingerprint("\t".join(words), 3) == want


def test_secret_at_the_end(spark):
    from rillmap.llm.secrets import scan

    text = "the river runs by the old town ü " * 150_000 + 'and password="Tr0ub4dor&3x" it is'
    row = scan(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string").coalesce(1)).where("doc_id = 1").first()
    at = len(text[: text.index("Tr0ub")].encode())
    assert [(s.start, s.end) for s in row.secrets] == [(at, at + 12)]


def test_toxic_word_at_the_end(spark):
    from rillmap.llm.toxicity import ChainField, Tokens, score_toxicity

    data = np.frombuffer(b"zzblock", np.uint8)
    model = ChainField()
    model.weight[Tokens(data, np.array([0, 7])).features[0]] = 12.0
    text = "the river runs by the old town " * 60_000
    rows = {r.doc_id: r for r in score_toxicity(spark.createDataFrame([(1, text + "zzblock"), (2, text), (3, None), (4, "a zzblock")], "doc_id long, text string").coalesce(1), None, model=model).collect()}
    assert [(s.start, s.end) for s in rows[1].spans] == [(len(text), len(text) + 7)] and [(s.start, s.end) for s in rows[4].spans] == [(2, 9)]
    assert not rows[2].spans and not rows[3].spans and rows[1].score > 0.9 > rows[2].score


def test_language_of_a_long_text(spark):
    from rillmap.llm.language import identify

    told = [(k, t, x) for k, (t, x) in enumerate([("the cat and the dog went out of the house", "en"), ("le chat et le chien sont ici avec nous", "fr")] * 8)]
    long = "le chien et le chat sont ici " * 150_000
    rows = [(100, long, None), (101, long + " the dog " * 10, None), (102, "the house", None), (103, None, None)]
    labelled = spark.createDataFrame(told, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, labelled.schema).coalesce(1), labelled).collect()}
    assert [got[k][0] for k in (100, 101, 102, 103)] == ["fr", "fr", "en", "und"] and got[100][1] > 0.95 and got[101][1] > 0.95


def test_words_of_a_long_text_are_mixed(spark):
    from rillmap.llm.mixing import mix_sources

    rows = [(1, "w\t" * 1_500_000, "a"), (2, "x y\n" * 500_000, "a"), (3, "z " * 200_000, "b"), (4, "", "b"), (5, None, None)]
    got = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[k].size for k in range(1, 6)] == [1_500_000, 1_000_000, 200_000, 0, 0]
    assert all(0 <= r.taken <= 2 * r.size for r in got.values()) and got[1].source_size == 2_500_000


def test_statistics_of_a_long_text_stand_for_themselves(spark):
    """A text longer than a block has the same statistics alone and among others, and as many small ones keep theirs."""
    from rillmap.llm.quality import features

    long = "The river of the north is known. It came from the lake, and went on!\n" * 40_000
    rows = [(1, "BUY now"), (2, long), (3, "A short text."), (4, None), (5, long)]
    kind = "doc_id long, text string"
    got = {r.doc_id: r.x for r in features(spark.createDataFrame(rows, kind).coalesce(1)).collect()}
    alone = {r.doc_id: r.x for k in range(5) for r in features(spark.createDataFrame([rows[k]], kind)).collect()}
    assert got == alone and got[2] == got[5]


def test_stages_take_long_texts(spark, tmp_path):
    """Two near copies of 2 MB: one stays, its secret is redacted, and what is left is mixed."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 9000, 300_000)]
    other = list(words)
    for k in range(0, 300_000, 1500):
        other[k] = "changed"
    rows = [(1, " ".join(words) + " password=Zx9kQ2mWp7vRt end", "en", "a", 1), (2, " ".join(other) + " end", "en", "a", 2), (3, "a clean and short text of some words", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    clean = {r.doc_id: r for r in corpus_pipeline.secrets(spark, spark.createDataFrame(kept, docs.schema), "").collect()}
    assert clean[1].text == " ".join(words) + " password=[REDACTED] end" and clean[1].n_chars == len(clean[1].text) and clean[3].text == rows[2][1]
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame(list(clean.values()), docs.schema), "").collect()
    assert mixed and all(r.text == clean[r.doc_id].text for r in mixed)
