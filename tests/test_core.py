"""Loaders, line filters, progress, naming and the whole run on hand-made rows."""

import json
import os

import pytest


def test_loader(spark, tmp_path):
    from rillmap.sources.loader import load_table, looks_like_json, looks_like_jsonl, save_table, sniff_encoding

    assert looks_like_json(" [1]") and not looks_like_json("a,b") and looks_like_jsonl('{"a":1}\n\n{"a":2}') and not looks_like_jsonl('{"a":1}')
    assert sniff_encoding("한".encode("cp949") * 3) == "cp949" and sniff_encoding("é".encode()) in ("utf-8", "utf-8-sig")
    files = {
        "a.jsonl": ('{"id": "0704.0001", "title": "x"}\n{"id": "2", "title": "y"}\n', "jsonl", 2), "b.json": ('[{"id": 1}, {"id": 2}, {"id": 3}]', "json:array", 3),
        "c.json": ('{"items": [{"id": 1}, {"id": 2}]}', "json:items", 2), "d.json": ('{"a": {"b": 1}, "c": 2}', "json:object", 1),
        "e.csv": ("id;title\n1;x\n2;y\n", "csv", 2), "f.csv": ('id,title\n1,"a,b"\n2,c\n', "csv", 2),
    }
    for name, (text, kind, n) in files.items():
        (tmp_path / name).write_text(text)
        df, facts = load_table(spark, str(tmp_path / name))
        assert (facts["format"], df.count()) == (kind, n), name
    assert load_table(spark, str(tmp_path / "a.jsonl"))[0].first()["id"] == "0704.0001"
    assert load_table(spark, str(tmp_path / "d.json"))[0].columns == ["a.b", "c"]
    assert save_table(spark.range(3), str(tmp_path / "out")).endswith("out.parquet")


def test_lines(spark, tmp_path):
    from rillmap.sources.jsonl import count_before, rewrite_before, table_before, to_csv
    from rillmap.streaming.jsonl import stream_before

    lines = ['{"update_date": "2001-02-03", "id": 1}', "", "{broken", "[1]", '{"update_date": "2009-01-01"}', '{"update_date": "abcd"}', '{"id": 5}', '{"update_date": "99"}']
    os.makedirs(tmp_path / "in")
    path = str(tmp_path / "in" / "a.jsonl")
    open(path, "w").write("\n".join(lines))
    assert count_before(spark, path, 2005) == 2
    with pytest.raises(Exception):
        count_before(spark, path, 2005, "raise")
    assert table_before(spark, path, 2005, "skip").count() == 2
    assert rewrite_before(spark, path, str(tmp_path / "out"), 2005) == 2
    assert to_csv(spark, str(tmp_path / "out"), str(tmp_path / "csv"))[0] == 2
    stream_before(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "mark"), 2005).awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "stream")).collect()) == sorted([lines[0], lines[7]])


def test_progress():
    from rillmap.config import COMPONENT_STEPS, ELEMENT_STEPS
    from rillmap.plans.progress import Progress, RunState, StepTimer

    p, q = Progress(), Progress(renormalise=True)
    for x in (p, q):
        for name, _ in ELEMENT_STEPS + COMPONENT_STEPS:
            if name != "component_result":
                x.update(name, 2)
    assert (int(p.component() * 100), int(p.overall() * 100), int(q.overall() * 100 + 1e-9)) == (89, 98, 100)
    ticks = iter([0.0, 10.0, 20.0])
    t = StepTimer(clock=lambda: next(ticks))
    assert t.eta_seconds(1, 2) is None
    t.start()
    assert t.eta_seconds(5, 10) == 10.0 and t.eta_seconds(10, 10) == 0
    s = RunState()
    s.begin("element", "upload")
    assert s.heartbeat(0.999)["step_progress"] == 99


def test_answers():
    from rillmap.operators.naming import ask, read_answer, six_fields

    assert read_answer('```json\n{"en_name": "A", "why": 3}\n```') == {"en_name": "A", "why": 3}
    assert read_answer("a: 1\nb : two ") == {"a": "1", "b": "two"} and read_answer("none") == {}
    assert six_fields({"en_name": "A", "why": 3, "purpose": None, "summary": "s"}) == {"tech_name_ko": "", "tech_name_en": "A", "purpose": "s", "method": "", "novelty": "", "rationale": "3"}

    class Flaky:
        model, calls = "m", 0

        def answer(self, system, user):
            self.calls += 1
            if self.calls < 3:
                raise OSError("busy")
            return "{}"

    assert ask(Flaky(), "x", sleep=lambda s: None) == "{}"


def test_embedding_checkpoint(spark, tmp_path):
    from rillmap.operators.embedding import embed

    df = spark.createDataFrame([(1, "neural nets learn"), (2, "graph data"), (3, None)], "doc_id long, title string")
    one = {r.doc_id: r.embedding for r in embed(df, checkpoint=str(tmp_path / "c")).collect()}
    two = {r.doc_id: r.embedding for r in embed(df.union(df.where("doc_id = 1").selectExpr("9L", "title")), checkpoint=str(tmp_path / "c")).collect()}
    assert len(one[1]) == 384 and two[1] == one[1] == two[9] and spark.read.parquet(str(tmp_path / "c")).count() == 4


def test_panel_merge(spark):
    from rillmap.operators.flows import flow_panel

    edges = [(2000, 2003, 1, 5, 0.5, 3, 4), (2000, 2003, 2, 5, 0.5, 2, 4), (2003, 2004, 5, 7, 0.5, 4, 6), (2003, 2004, 6, 8, 0.5, 1, 2)]
    panel = flow_panel(spark.createDataFrame(edges, "year_from int, year_to int, prev_id int, next_id int, similarity double, docs_from long, docs_to long"))
    got = {(r.year, r.cluster_id): (r.flow_id, r.docs) for r in panel.collect()}
    assert got == {(2000, 1): (0, 3), (2000, 2): (1, 2), (2003, 5): (0, 4), (2004, 7): (0, 6), (2003, 6): (2, 1), (2004, 8): (2, 2)}


def test_the_recursive_panel_is_the_same(spark):
    """Chains, merges and gaps over more than a hundred years; no edges give no rows."""
    import random

    from rillmap.operators.flows import flow_panel, flow_panel_recursive

    rng = random.Random(2)
    edges = [(y, y + 1, 0, 0, 0.5, 1, 1) for y in range(1880, 2010)]  # one flow of 131 years
    edges += [(y, y + 1, c, rng.randrange(1, 7), 0.5, c, c) for y in range(1990, 2005) for c in range(1, 7) if rng.random() < 0.8]
    kind = "year_from int, year_to int, prev_id int, next_id int, similarity double, docs_from long, docs_to long"
    for rows in (edges, edges[:3], []):
        df = spark.createDataFrame(rows, kind)
        assert sorted(map(tuple, flow_panel_recursive(df).collect())) == sorted(map(tuple, flow_panel(df).collect()))


def test_preprocess_boundaries(spark):
    from rillmap.operators import prep

    rows = [(1, "Metadata", "", None), (2, "", "", "2001-01-01"), (3, " ", None, "2002-05-06"), (4, "virtual", "x", "junk")]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract string, update_date string")
    got = {r.doc_id: r.year for r in prep.clean_nonempty(prep.before_year(df, 2010)).collect()}
    assert got == {1: -1, 3: 2002, 4: -1}
    assert [r.doc_id for r in prep.preprocess(df).orderBy("doc_id").collect()] == [1, 4]
    kept = prep.clean_nonempty(spark.createDataFrame([(None, None)], "title string, abstract string"), literal_nulls=True)
    assert kept.first().title == "nan"


def test_whole_run(spark, tmp_path):
    from rillmap.config import EngineConfig
    from rillmap.plans.pipeline import Pipeline

    topics = ["graph data mining of large networks", "virtual reality headsets for training", "software testing with algorithm models"]
    with open(tmp_path / "p.jsonl", "w") as f:
        for k in range(60):
            f.write(json.dumps({"title": f"{topics[k % 3]} part {k % 7}", "abstract": topics[k % 3], "update_date": f"{2001 + k // 30}-01-02"}) + "\n")
    run = Pipeline(spark, EngineConfig(n_clusters=3, n_components=2, top_flows=5))
    events = list(run.run(str(tmp_path / "p.jsonl")))
    assert not [e for e in events if e.get("type") == "error"], events[-2]
    assert events[-1]["type"] == "stream-close" and events[-2]["overall_progress"] >= 98
    assert run.panel.count() == 6 and events[-2]["elements"] and events[-2]["edges"]
    bad = list(Pipeline(spark).run(str(tmp_path / "missing.jsonl")))
    assert [e.get("type") for e in bad[-2:]] == ["error", "stream-close"]


@pytest.mark.parametrize("encoding", ["utf-8", "cp949", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    from rillmap.sources.loader import load_table

    word = "café" if encoding == "latin-1" else "한국어 논문"
    rows = [{"id": str(k), "title": f"{word} {k}"} for k in range(40)]
    lines = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    for name, text in (("a.jsonl", lines), ("b.json", json.dumps(rows, ensure_ascii=False)), ("c.csv", "id,title\n" + "\n".join(f"{r['id']},{r['title']}" for r in rows))):
        (tmp_path / name).write_bytes(text.encode(encoding))
        df, _ = load_table(spark, str(tmp_path / name))
        assert {r.title for r in df.collect()} == {r["title"] for r in rows}, name


def test_vectors_as_text(spark):
    from pyspark.sql import functions as F

    from rillmap.functions.vectors import parse_vector

    rows = [("[1, 2.5]", [1.0, 2.5]), ("(1, 2,)", [1.0, 2.0]), (" [] ", []), ("[1, null, 2]", None), ("[1, x]", None), ("no vector", None), (None, None)]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", parse_vector(F.col("t")).alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == [v for _, v in rows]


def test_hanging_provider():
    import time

    from rillmap.operators.naming import ask

    class Hangs:
        model = "x"

        def answer(self, system, user):
            time.sleep(5)

    began = time.time()
    with pytest.raises(TimeoutError):
        ask(Hangs(), "?", tries=2, sleep=lambda _: None, timeout=0.2)
    assert time.time() - began < 3


def test_progress_within_a_step(spark, monkeypatch):
    import time

    from rillmap.plans import pipeline

    def slow(batches):
        time.sleep(0.7)
        yield from batches

    monkeypatch.setattr(pipeline, "POLL", 0.2)
    run = pipeline.Pipeline(spark)
    watched = run._watched("element", "embedding", lambda: spark.range(0, 40, 1, 12).mapInArrow(slow, "id long").count())
    events = []
    while True:
        try:
            events.append(next(watched))
        except StopIteration as end:
            assert end.value == 40
            break
    shares = [e["step_progress"] for e in events]
    assert shares == sorted(shares) and any(0 < s < 100 for s in shares)


def test_most_frequent_terms(spark):
    """Ranked in parts, the vocabulary is still the most frequent terms of each scope, ties by term."""
    from rillmap.operators.tfidf import document_frequency

    tf = spark.createDataFrame([(y, d, f"t{k:03d}", 1 + (k * 7 + y) % 5) for y in (1, 2) for d in range(3) for k in range(200)], "year int, doc_id int, term string, tf int")
    docs = tf.select("year", "doc_id").distinct()
    total = {(y, f"t{k:03d}"): 3 * (1 + (k * 7 + y) % 5) for y in (1, 2) for k in range(200)}
    got = {(r.year, r.term) for r in document_frequency(tf, docs, ["year"], max_features=70).collect()}
    assert got == {(y, t) for y in (1, 2) for t in sorted((t for z, t in total if z == y), key=lambda t: (-total[y, t], t))[:70]}
    both = {t: total[1, t] + total[2, t] for _, t in total}
    flat = tf.withColumn("doc_id", tf.doc_id + 10 * tf.year)
    got = {r.term for r in document_frequency(flat, flat.select("doc_id").distinct(), max_features=70).collect()}
    assert got == set(sorted(both, key=lambda t: (-both[t], t))[:70])


def test_diagnostic_rows(spark):
    from pyspark.sql import functions as F

    from rillmap.operators.tfidf import diagnostics

    rows = [(1, "a of the"), (1, None), (2, "graph data"), (2, ""), (3, None), (3, "  ")]
    got = diagnostics(spark.createDataFrame(rows, "year int, title string"), F.col("title")).orderBy("year").collect()
    assert [(r.year, r.cluster_id, r.term, r.tfidf, r.docs, r.reason, r.n) for r in got] == [(1, None, "", 0.0, 0, "empty_vocabulary", 2), (3, None, "", 0.0, 0, "no_text", 2)]


def test_large_vocabularies_are_whole(spark):
    """More terms than the 120,000 that the vocabulary once kept."""
    from pyspark.sql import functions as F

    from rillmap.operators.tfidf import document_frequency, term_counts

    docs = spark.range(15).selectExpr("id as doc_id", "array_join(transform(sequence(0, 4999), x -> concat('w', id * 5000 + x)), ' ') as title")
    tf = term_counts(docs, F.col("title"))
    assert document_frequency(tf, docs).count() == 15 * (5000 + 4999)


def test_titles_are_cut_before_the_dates_join(spark, tmp_path):
    """Whole texts stay out of the joins where only titles are wanted."""
    from rillmap.plans.papers import papers

    spark.sql("select 1L doc_id, 'a title\\nand a text' text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select 1L o_orderkey, date'1999-02-03' o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select 1L vec_id, array(1f) embedding, 3 label").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = papers(spark, str(tmp_path)).select("doc_id", "year", "cluster_id", "title")
    assert [tuple(r) for r in rows.collect()] == [(1, 1999, 3, "a title")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" in plan and plan.rindex("Join") < plan.index("substring_index")


@pytest.mark.parametrize("name", ["flow_keywords", "names_offline"])
def test_flow_words_count_terms_once(spark, monkeypatch, name):
    from unittest.mock import MagicMock

    from rillmap import catalog

    counts, profiled, moved = [], [], []
    monkeypatch.setattr(catalog.tfidf, "counted", lambda *a, **k: counts.append(MagicMock()) or counts[-1])
    monkeypatch.setattr(catalog.tfidf, "cluster_terms", lambda *a, known=None, **k: profiled.append(known))
    monkeypatch.setattr(catalog.transitions, "transitions", lambda *a, known=None, **k: moved.append(known))
    for module, f in ((catalog.transitions, "flow_edges"), (catalog.flows, "flow_panel"), (catalog.flows, "flow_keywords"), (catalog.flows, "top_flows"), (catalog.naming, "name_groups"), (catalog, "papers"), (catalog, "_round")):
        monkeypatch.setattr(module, f, MagicMock())
    getattr(catalog, name)(spark, "")
    assert len(counts) == 1 and profiled == moved == counts
