"""The corpus pipeline on small tables, and the trained operators' held-out accuracy."""

import pytest
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    good = [f"The {a} of {b} is known. It came from {b} and went to {a}." for a in ("river", "town", "garden", "mountain") for b in ("north", "south", "valley", "lake", "old wood")]
    rows = [(k, f"{good[k % 20]} Part {k} tells of {good[(k * 7 + 3) % 20]}" + (" you idiotic scum" if k % 5 == 0 else ""), "en", "ab"[k % 2], 0) for k in range(120)]
    rows += [(k, "BUY!! NOW!! " * 30, "en", "a", 0) for k in range(120, 160)] + [(160, None, None, None, None), (161, "", None, "a", 0), (162, "password=8f3a1c09bb27de64aa11 " + good[0], "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(k, int(k < 120), int(k < 120 and k % 5 == 0)) for k in range(0, 160)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_run(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append(docs.count())
    assert kept[1] <= kept[0] <= 163
    # where documents are cut depends on how they are read, what is packed does not
    tokens = lambda pieces: sorted((r.doc_id, r.length) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("length")).collect())
    assert tokens(corpus_pipeline.run(spark, folder)) == tokens(docs)


def test_secrets_are_redacted(spark, folder):
    from rillmap.llm.secrets import redact

    rows = {r.doc_id: r.text for r in redact(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert rows[162].startswith("password=[REDACTED] The") and rows[160] is None and len(rows) == 163


@pytest.mark.parametrize(("name", "label"), [("op6_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out(spark, folder, name, label):
    from rillmap.llm.queries import queries

    got = {r.doc_id: r for r in queries()[name](spark, folder).collect()}
    assert len(got) == 163 and all(0 <= r.score <= 1 for r in got.values())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [k for k in truth if got[k].held_out]
    assert sum(got[k].predicted == truth[k] for k in held) >= 0.9 * len(held)


def test_language(spark, folder):
    from rillmap.llm.language import identify

    rows = [(k, t, x) for k, (t, x) in enumerate([("the cat and the dog went out", "en"), ("le chat et le chien sont ici", "fr"), ("der hund und die katze sind da", "de")] * 8)]
    rows += [(100, None, None), (101, "123 !!", None), (102, "le chien et le chat", None), (103, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, df).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows[:24]) and got[102].lang_pred == "fr"
    assert [got[k].lang_pred for k in (100, 101, 103)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
