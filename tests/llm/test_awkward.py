"""Clashing extra columns, nulls, empty tables and repeated rows for every operator's query."""

import pytest
from pyspark.sql import functions as F

from rillmap.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"
CLASHES = ("id", "v", "x", "t", "g", "fp", "a", "b", "node", "root", "codes", "ids", "score", "label", "size", "target", "source_size", "pattern", "taken", "held_out", "component_id", "start", "offset", "word", "spans", "doc_tokens")
TRAINED = ("op4_language_id", "op6_quality", "op10_toxicity")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same tables without and with extra columns."""
    good = "The committee reviewed the results of the long study and found them useful for later work."
    texts = [None, "", " \n\t ", "x", "ñandú 東京 🙂", good, good, "word " * 20000] + [f"{good} Case {k} adds some words of its own, {k * 7} in all." for k in range(20)] + ["!!!! $$$ 0000 " * 4 + str(k) for k in range(12)]
    docs = [(k, t, None if k % 7 == 0 else "en" if k % 2 else "de", None if k % 5 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts)] + [(None, good, None, None, None), (5, good, "en", "s1", 1)]
    labels = [(k, int(k < 28), int(k % 9 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 0, 1)]
    vectors = [(k, [float(k % 5), 1.0, float(-k)], k) for k in range(45)] + [(50, None, None), (51, [], 1), (52, [0.0] * 3, 1), (53, [None, 1.0, 2.0], 1), (54, [float("inf"), 1.0, 2.0], 1), (None, [1.0, 2.0, 3.0], 1), (1, [1.0, 1.0, -1.0], 1)]
    top = tmp_path_factory.mktemp("awkward")
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("embeddings", vectors, VECTORS), ("benchmark", [(1, good), (None, None), (2, "")], "item_id long, text string")):
        plain = spark.createDataFrame(rows, schema).coalesce(2)
        plain.write.parquet(f"{top}/plain/{name}.parquet")
        extra = plain.select("*", *(F.lit(7).alias(c) for c in CLASHES if c not in plain.columns))
        extra.write.parquet(f"{top}/extra/{name}.parquet")
        plain.limit(0).write.parquet(f"{top}/empty/{name}.parquet")
        (plain.limit(0) if name == "labels" else plain).write.parquet(f"{top}/unlabelled/{name}.parquet")
    return top


@pytest.mark.parametrize("name", sorted(n for n in queries() if n.startswith("op") and not n.startswith("op7")))
def test_extra_columns_change_nothing(spark, folders, name):
    rows = [sorted(map(str, queries()[name](spark, f"{folders}/{kind}").collect())) for kind in ("plain", "extra")]
    assert rows[0] and rows[0] == rows[1]


@pytest.mark.parametrize("name", TRAINED)
def test_trained_on_nothing(spark, folders, name):
    assert queries()[name](spark, f"{folders}/empty").count() == 0
    rows = queries()[name](spark, f"{folders}/unlabelled").collect()
    assert len(rows) == spark.read.parquet(f"{folders}/unlabelled/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_packing_with_extra_columns(spark, folders):
    pytest.importorskip("tokenizers")
    for kind in ("plain", "extra"):
        rows = queries()["op7_packing"](spark, f"{folders}/{kind}").collect()
        docs = {(r.doc_id, r.doc_tokens) for r in rows}
        assert sum(r.length for r in rows) >= sum(n for _, n in docs)
        assert {d for d, _ in docs} == {r.doc_id for r in spark.read.parquet(f"{folders}/{kind}/documents.parquet").collect()}


def test_pipeline_on_awkward_tables(spark, folders):
    """Clashing columns, nulls, repeated rows, a long text, no labels, no rows: each stage keeps to its columns."""
    pytest.importorskip("tokenizers")
    import corpus_pipeline

    for kind, some in (("plain", True), ("extra", True), ("empty", False), ("unlabelled", False)):
        docs = spark.read.parquet(f"{folders}/{kind}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, f"{folders}/{kind}")
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
            assert k == 4 or docs.columns == columns
        assert bool(rows) == some, kind


@pytest.mark.parametrize("name", ["near_duplicates", "secrets", "mixture"])
def test_stages_alone(spark, folders, name):
    """On unfiltered rows with clashing columns: equal to the rows without them."""
    import corpus_pipeline

    stage, out = dict(corpus_pipeline.STAGES)[name], []
    for kind in ("plain", "extra"):
        docs = spark.read.parquet(f"{folders}/{kind}/documents.parquet")
        out.append(sorted(map(str, stage(spark, docs, f"{folders}/{kind}").select("doc_id", "text", "source").collect())))
    assert out[0] == out[1] and out[0]
