"""Events, files and names of a run."""

import base64
import csv
import io
import json

import pytest
from pyspark.sql import functions as F


def test_csv_text_is_what_pandas_writes(spark):
    import pandas as pd

    from rillmap.sources.payload import csv_file, csv_text

    rows = [(3, 'a,"b"', None, "line\nbreak"), (1, None, 7, "\r"), (2, "", 8, "한글"), (2, "x", None, " ")]
    df = spark.createDataFrame(rows, "id int, text string, n long, `odd, name` string")
    want = pd.DataFrame(sorted(rows, key=lambda r: (r[0], r[1] or "")), columns=df.columns).astype({"n": "Int64"}).to_csv(index=False)
    got = csv_text(df.repartition(3), F.col("id"), F.coalesce("text", F.lit(""))).first()
    assert got.csv_text == want and base64.b64decode(got.content).decode() == want
    assert csv_file(df.where("false"), "x.csv", F.col("id"))["content"] == base64.b64encode(b'id,text,n,"odd, name"\n').decode()
    one = csv_text(df.select("text"), F.col("text")).first().csv_text
    assert one == pd.DataFrame({"text": [None, "", 'a,"b"', "x"]}).to_csv(index=False, na_rep="")


def run(spark, path, **setting):
    from rillmap.config import EngineConfig
    from rillmap.plans.pipeline import Pipeline

    pipeline = Pipeline(spark, EngineConfig(n_clusters=3, n_components=2, top_flows=5), **setting)
    events = list(pipeline.run(str(path)))
    assert not [e for e in events if e.get("type") == "error"], events[-2]
    return pipeline, [json.loads(json.dumps(e)) for e in events]


def papers(n=60):
    topics = ["software graph algorithm", "virtual cell data", "augmented light reality"]
    return [(str(k), f"{topics[k % 3]} part {k % 7}", topics[k % 3], f"{2001 + k // 30}-01-02") for k in range(n)]


def test_a_run_over_delimited_text(spark, tmp_path, monkeypatch):
    """Files and counters are in the events, malformed rows are counted, every step is watched, repeated ids stay."""
    from rillmap.plans import pipeline as module

    monkeypatch.setattr(module, "POLL", 0.02)
    rows = [(str(int(r[0]) % 40), *r[1:]) for r in papers()]  # 20 ids come twice
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("doc_id", "title", "abstract", "update_date"), *rows, ("9", "too", "many", "fields", "here")])
    (tmp_path / "p.csv").write_text(out.getvalue())
    pipeline, events = run(spark, tmp_path / "p.csv", checkpoint=str(tmp_path / "vectors"))
    done = {e["step"]: e for e in events if e.get("step_progress") == 100}
    assert done["preprocess"]["meta"] == {"rows_after_filter": 60, "malformed": 1} and done["embedding"]["meta"] == {"rows": 60, "without_vector": 0}
    assert pipeline.clusters.docs.count() == 60 and sum(r["count"] for r in pipeline.clusters.counts.collect()) == 60
    assert {r.status for r in pipeline.clusters.report.collect()} == {"clustered"} and done["clustering"]["meta"]["left_out"] == []
    for step, name, key in (("tech_naming", "names_generated_flowagg.csv", "flow_id"), ("component_result", "component_tech_names.csv", "component_tech_id")):
        (file,) = done[step]["files"]
        table = list(csv.DictReader(io.StringIO(base64.b64decode(file["content"]).decode())))
        assert file["filename"] == name and table and key in table[0] and table[0]["tech_name_en"] and file["mime"] == "text/csv; charset=utf-8"
    assert [int(r["docs"]) for r in table] == sorted((int(r["docs"]) for r in table), reverse=True)
    told = {e["step"] for e in events if 0 < e.get("step_progress", 0) < 100}
    assert {"embedding", "clustering", "component_grouping"} <= told
    overall = [e["overall_progress"] for e in events if "overall_progress" in e]
    assert overall == sorted(overall)


def test_a_client_without_json_mode_is_asked_without():
    from rillmap.operators.naming import ChatNames, read_answer

    asked = []

    def knows(model, messages, temperature, timeout, response_format=None):
        asked.append(response_format)
        return '{"ko_name": {"deep": 1}}'

    def older(model, messages, temperature, timeout):
        asked.append("none")
        return None

    assert read_answer(ChatNames(knows, "m").answer("s", "u")) == {"ko_name": {"deep": 1}} and asked == [{"type": "json_object"}]
    old = ChatNames(older, "m")
    assert [old.answer("s", "u"), old.answer("s", "u")] == ["{}", "{}"] and asked[1:] == ["none", "none"] and not old.json_mode

    def broken(**_):
        raise TypeError("other")

    with pytest.raises(TypeError, match="other"):
        ChatNames(broken, "m").answer("s", "u")
    assert read_answer('Here: ```json\n{"a": "b"}\n``` done') == {"a": "b"} and read_answer("[1]\nkey: value") == {"key": "value"}


def test_what_is_said_of_seconds(spark):
    from rillmap.plans.progress import eta_text, format_eta, progress_of

    seconds = [None, 0.0, 0.99, 1.0, 59.99, 60.0, 75.0, 105.0, 63.0, 69.0, 3599.0, 100000.0, *[k / 7 for k in range(0, 3000, 13)]]
    got = spark.createDataFrame(list(enumerate(seconds)), "k int, s double").select("k", eta_text(F.col("s")).alias("said")).orderBy("k").collect()
    assert [r.said for r in got] == [format_eta(s) for s in seconds]
    assert format_eta(None) == "예상 소요 시간: 계산 중" and format_eta(0.2) == "예상 소요 시간: 거의 완료" and format_eta(61) == "예상 소요 시간: 1.0분"
    told = [("a", "upload", 1.0), ("a", "embedding", 0.5), ("a", "embedding", 2.0), ("a", "visualize", -1.0), ("b", "nothing", 1.0), (None, "load", None)]
    rows = {r.run: (round(r.element, 9), r.component, round(r.overall, 9)) for r in progress_of(spark.createDataFrame(told, "run string, step string, share double")).collect()}
    assert rows == {"a": (0.4, 0.0, 0.34), "b": (0.0, 0.0, 0.0), None: (0.0, 0.0, 0.0)}
