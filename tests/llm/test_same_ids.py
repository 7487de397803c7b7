"""Substring deduplication of different texts under one id whose hashes agree in their low 23 bits."""

import xxhash

from .test_exact import DOCS, removed_by_force


def test_texts_told_apart(spark):
    from rillmap.llm.substring_dedup import remove_repeats

    words = " ".join(f"w{j}" for j in range(60))
    one, two = f"text 298 {words} end 298", f"text 2154 {words} end 2154"
    tag = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFF
    assert tag(one) == tag(two)
    for doc_id in (None, 7):
        rows = [(doc_id, one, "en", "a", 0), (doc_id, two, "en", "a", 0), (9, two + " and more of it, which nothing repeats " + one[:90], "en", "a", 0)]
        got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(2), 100).collect()
        # brute force orders equal tags by the text; either order keeps one whole text and the other's own bytes
        size = lambda rows: sorted((r[0] is None, r[0], r[1], r[3]) for r in rows if r[0] == 9)
        assert size(tuple(r) for r in got) == size(removed_by_force(rows, 100))
        own = sorted(r.n_removed for r in got if r.doc_id == doc_id)
        assert own == [0, len(f" {words} end 2")], own
