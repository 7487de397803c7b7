"""The embedding checkpoint: nothing is encoded twice, the history is never dealt."""

import pytest
from pyspark.sql import functions as F

from rillmap.operators.embedding import HashingEncoder, embed
from rillmap.sources.bucketed import BucketedTable

SCHEMA = "k long, h string, embedding array<float>"


def Counting(path, name="counting"):  # noqa: N802
    """An encoder that tells of each text by a letter in a file, as workers cannot count together."""

    class Own(HashingEncoder):  # within the function, so that workers get it by value
        def encode(self, texts):
            with open(self.path, "a") as f:
                f.write("x" * len(texts))
            return HashingEncoder.encode(self, texts)

    own = Own(8)
    own.path, own.name = str(path), name
    return own


def texts(spark, ids, word="graph"):
    return spark.createDataFrame([(i, f"{word} data number {'abc' * (i % 3)}") for i in ids], "doc_id long, title string")


def test_a_resume_encodes_and_deals_new_rows_only(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "c")
    model = Counting(log)
    first = {r.doc_id: r.embedding for r in embed(texts(spark, range(40)), model, folder).collect()}
    assert len(log.read_text()) == 40
    second = {r.doc_id: r.embedding for r in embed(texts(spark, range(60)), model, folder).collect()}
    assert len(log.read_text()) == 60 and all(second[k] == v for k, v in first.items()) and len(second) == 60
    changed = embed(texts(spark, range(5), "light"), model, folder).collect()
    assert len(log.read_text()) == 65 and all(r.embedding != first[r.doc_id] for r in changed)
    embed(texts(spark, range(5)), Counting(log, "another"), folder).count()
    assert len(log.read_text()) == 70
    plain = {r.doc_id: r.embedding for r in embed(texts(spark, range(60)), model).collect()}
    assert plain == second


def exchanges_over(plan, scan):
    """Of each line of the plan that names `scan`, how many exchanges stand above it (less deep, before it)."""
    found, above = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [(d, e) for d, e in above if d < depth] + [(depth, "Exchange" in line)]
        if scan in line:
            found.append(sum(e for _, e in above))
    return found


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_the_history_is_not_shuffled(spark, tmp_path, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        folder = str(tmp_path / "c")
        embed(texts(spark, range(40)), checkpoint=folder).count()
        table = BucketedTable(spark, folder, SCHEMA)
        rows = texts(spark, range(50)).select(F.col("doc_id").alias("k"), F.lit("h").alias("h"))
        for df in (table.missing(rows), embed(texts(spark, range(40)), checkpoint=folder), table.read()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "bucketed_" in plan or "FileScan" in plan
            if threshold == "-1":
                assert exchanges_over(plan, "FileScan parquet") and not any(exchanges_over(plan, "FileScan parquet")), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_compaction_keeps_the_entries(spark, tmp_path):
    folder = str(tmp_path / "c")
    table = BucketedTable(spark, folder, SCHEMA, buckets=4, most_files=3)
    for k in range(6):
        table.append(spark.createDataFrame([(i, f"h{k % 2}", [float(k)]) for i in range(10)], SCHEMA))
    assert table.version > 1 and table.read().count() == 20
    again = BucketedTable(spark, folder, SCHEMA)
    assert again.buckets == 4 and again.version == table.version and again.read().count() == 20
    again.compact()
    names = [n for n in again._names(f"{again.home}/version={again.version}") if n.startswith("part-")]
    assert len({n.split("_")[-1][:5] for n in names}) == len(names) <= 4 and len(again._names(again.home)) == 1 and again.read().count() == 20


def test_keys_of_any_kind(spark, tmp_path):
    rows = [("a", "one text"), ("a", "one text"), ("a", "other text"), (None, "no key"), ("b", None)]
    df = spark.createDataFrame(rows, "id string, title string").withColumn("embedding", F.lit("old"))
    for folder in (None, str(tmp_path / "c")):
        found = embed(df, Counting(tmp_path / "log"), folder, key="id").collect()
        assert len(found) == 5 and [r.embedding is None for r in found].count(True) == (0 if folder is None else 1)
        assert len({tuple(r.embedding) for r in found if r.id == "a"}) == 2
