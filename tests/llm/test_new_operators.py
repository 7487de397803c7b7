"""The manifest, importance resampling and window dedup against plain reckonings, on awkward tables and as whole queries."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmap.llm import window_dedup
from rillmap.llm.manifest import audit, folded, manifest
from rillmap.llm.oracles import oracle_sql
from rillmap.llm.queries import queries
from rillmap.llm.resampling import LONG, features, resample
from rillmap.llm.window_dedup import pack_gaps, remove_repeated_windows, unpack_gaps

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """(root, siblings of every leaf by level)."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parts = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, under in enumerate(at):
            part, k = parts[i // fanout], i % fanout
            for x in under:
                paths[x].append(("".join(part[:k]), "".join(part[k + 1 :])))
        at = [sum(at[i : i + fanout], []) for i in range(0, len(at), fanout)]
        nodes = [sha("".join(p)) for p in parts]
    return (nodes[0] if nodes else None), paths


def plain_manifest(rows, fanout):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([leaf(r) for r in groups[s]], fanout) for s in names}
    root, above = tree([subs[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        for r, path in zip(groups[s], subs[s][1], strict=True):
            path = path + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            own = leaf((*r[:4], r[4].replace("\n", "") if tampered and r[4] is not None else r[4]))
            for left, right in path:
                own = sha(left + own + right)
            out.append((r[0], leaf(r), subs[s][0], root, sha("".join(a + b for a, b in path)), own, own == root))
    return out


def audited(spark, rows, fanout=3, extra=False):
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        docs = docs.withColumns({"leaf": F.lit("x"), "idx": F.lit(1), "node": F.lit(None).cast("int"), "tree": F.lit(2)})
    tampered = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")
    return audit(docs, tampered, {"text": F.expr("replace(text, '\\n', '')")}, fanout)


def awkward_documents(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "", None, "é", "z", "\U0001f600", "-", "=a"])
        rows.append((rng.choice([i, i, i, 7, None]), source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "one\ntwo", "x", "\n", "long\n" * 2000])))
    return rows + rows[:9]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("fanout", [3, 2])
def test_manifest_is_the_plain_tree(spark, fanout):
    rows = awkward_documents(fanout)
    found = [tuple(r) for r in audited(spark, rows, fanout, extra=True).collect()]
    assert sorted(found, key=key) == sorted(plain_manifest(rows, fanout), key=key)


def test_manifest_of_one_source_one_row_and_none(spark):
    for rows in ([(1, "a", "en", 1, "t")], [(i, None, None, None, f"t{i}\n") for i in range(10)], [(i, f"s{i}", None, 2, "t") for i in range(11)], []):
        found = [tuple(r) for r in audited(spark, rows).collect()]
        assert sorted(found, key=key) == sorted(plain_manifest(rows, 3), key=key)


def test_a_proof_folds_to_the_root_and_keeps_other_columns(spark):
    leaves = spark.createDataFrame([(i, "s" if i % 3 else None, sha(str(i)), [i]) for i in range(40)], "doc_id long, source string, leaf string, more array<int>")
    rows = manifest(leaves).withColumn("again", folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == 40 and all(r.again == r.root and r.more == [r.doc_id] for r in rows) and len({r.root for r in rows}) == 1


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def plain_features(text, longest):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, buckets, longest, percent, least):
    count = lambda texts: np.bincount([c % buckets for t in texts for c in plain_features(t, longest)], minlength=buckets) if texts else np.zeros(buckets, int)
    s, t = count([d[1] for d in docs]), count(target)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (s.sum() + buckets) / ((float(s[b]) + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        f = plain_features(text, longest)
        weight = sum(gain[c % buckets] for c in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return [tuple(r) for r in out]


TEXTS = [None, "", "One two THREE", "É é ÿ漢字, 中文。x", "a" * (LONG + 1) + " b " + "c" * 500, "tab\tnew\nline\x00nul\x7fdel", "`{[@/:", "z" * LONG + "-9", "dot.dot..dot", "x", "Ümlaut KK", "the cat " * 40]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_the_automaton_finds_every_run_of_words(longest):
    import pyarrow as pa

    from rillmap.llm.common import byte_view

    found, heads = features(*byte_view(pa.array(TEXTS)), longest)
    for k, text in enumerate(TEXTS):
        got = [int(c) for crc, first in found for c in crc[(first >= heads[k]) & (first < heads[k + 1])]]
        assert got == plain_features(text, longest), text


def test_resampling_is_the_plain_reckoning(spark):
    rng = random.Random(3)
    docs = [(rng.choice([i, i, 5, None]), rng.choice([*TEXTS, " ".join(rng.choices("alpha beta gamma delta x y z".split(), k=rng.randrange(60)))])) for i in range(200)]
    target = ["alpha beta gamma", None, "beta gamma delta x"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("?"), "rank": F.lit(0), "tie": F.lit(0)})
    found = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets=50, least=20)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_resample(docs, target, 50, 2, 25, 20), key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample(empty, empty).collect() == []
    assert sorted(map(tuple, resample(frame, empty, buckets=50).collect()), key=key) == sorted(plain_resample(docs, [], 50, 2, 25, 20), key=key)


def plain_windows(docs, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    own = [float("inf") if d is None else d for d, _ in docs]
    least = {}
    for d, w in zip(own, split, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, d), d)
    out = []
    for (doc_id, _), d, w in zip(docs, own, split, strict=True):
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), sha(kept), kept))
    return out


@pytest.mark.parametrize("width,bits", [(3, None), (5, 4), (1, 2), (3, 14)])
def test_windows_are_removed_as_by_brute_force(spark, monkeypatch, width, bits):
    monkeypatch.setattr(window_dedup, "BLOCK", 300)
    monkeypatch.setattr(window_dedup, "EXACT", 11)
    rng = random.Random(width)
    vocabulary = ["a", "b", "c", "é", "dog", "漢字", "Ünïcode nbsp", "x\x00y"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    docs = [(rng.choice([i, i, i, 4, None]), rng.choice([None, "", " \n", passage, "q " + passage + "\tr", *[" ".join(rng.choices([*vocabulary, str(i), str(i + 1)], k=rng.randrange(40))) for _ in range(6)]])) for i in range(120)]
    docs += docs[:10]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("?"), "block": F.lit(0), "slot": F.lit(None).cast("string")})
    found = remove_repeated_windows(frame.repartition(3), width, with_text=True, bits=bits)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_windows(docs, width), key=key)


def test_window_dedup_of_empty_tables_and_long_texts(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(empty).collect() == []
    rng = random.Random(1)
    long = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=200_000))
    docs = [(1, "start " + long), (2, long), (3, None)]
    found = remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found) == [(1, 200_001, 0), (2, 200_000, 200_000), (3, 0, 0)]


def test_gaps_come_back():
    for cells in ([0], [65535], [65534, 65535, 65536], [0, 1, 2**26 - 1], sorted(random.Random(0).sample(range(2**22), 500))):
        assert unpack_gaps(pack_gaps(np.array(cells))).tolist() == cells


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_whole_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    found = queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in found.select(*sorted(want.columns)).collect()), key=key) == sorted(want.select(*sorted(want.columns)).fetchall(), key=key)
