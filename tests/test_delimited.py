"""Delimited text: the same rows as the csv module finds in the whole file, however it is split."""

import csv
import io
import random

import pytest

from rillmap.sources.delimited import Quotes, column_names, read_delimited
from rillmap.sources.loader import load_table


def plain(text, sep=","):
    """(rows padded to the header's width, number of rows that are longer) by one reader over the whole text."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar='"', escapechar="\\") if r]
    width = len(rows[0])
    return [tuple(x or None for x in r + [""] * (width - len(r))) for r in rows[1:] if len(r) <= width], sum(len(r) > width for r in rows[1:])


def check(spark, path, text, sep=",", encoding="utf-8"):
    df, facts = read_delimited(spark, str(path), text[:5000], encoding)
    want, bad = plain(text, sep)
    rows = [tuple(r) for r in df.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert facts["sep"] == sep and facts["malformed"].get["malformed"] == bad
    assert df.count() == len(want) == len(df.select(f"`{df.columns[0]}`").collect())
    return df


def quoted(rng):
    kinds = ["plain", "", '"a,b"', '"two\nlines"', '"say ""x"""', '"say \\"y\\" \n"', 'it\\"s', '5" pipe', '"x"tail', '"\n\n,\n"', '"c\r\nd"', "é漢", '"\\\\"']
    return rng.choice(kinds)


@pytest.mark.parametrize("size", [64, 700])
def test_any_split_gives_the_rows_of_the_whole(spark, tmp_path, size):
    rng = random.Random(size)
    lines = ["id,title,more"] + [",".join([str(i), *(quoted(rng) for _ in range(rng.choice([0, 1, 2, 2, 2, 2, 3, 5])))]) for i in range(110)]
    text = "\n".join(lines) + "\n"
    (tmp_path / "a.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 3
        check(spark, tmp_path / "a.csv", text)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_record_longer_than_many_splits(spark, tmp_path):
    text = 'id,title\n1,"' + "long\n" * 200 + '"\n2,b\n3,"' + "x" * 300 + "\n" + 'y"\n4,"open to the end\nof the file\n'
    (tmp_path / "a.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    try:
        df, _ = read_delimited(spark, str(tmp_path / "a.csv"), text, "utf-8")
        rows = {r.id: r.title for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert rows == {"1": "long\n" * 200, "2": "b", "3": "x" * 300 + "\ny", "4": "open to the end\nof the file"}


def test_malformed_rows_are_the_same_whatever_is_read(spark, tmp_path):
    text = "id,title\n1,a\n2,b,c\n3\n4,d,e,f\n\n5,g\n"
    (tmp_path / "a.csv").write_text(text)
    df = check(spark, tmp_path / "a.csv", text)
    assert [r.id for r in df.select("id").orderBy("id").collect()] == ["1", "3", "5"] and df.where("id = '3'").first().title is None


def test_folders_names_and_encodings(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for k in range(4):
        (tmp_path / "many" / f"{k}.csv").write_bytes(("﻿" if k == 0 else "").encode() + f'\nid;id;;Ünï`c.ode"\r\n{k};"x\r\ny";z;"q"\r\n'.encode())
    df, facts = read_delimited(spark, str(tmp_path / "many"), '\nid;id;;Ünï`c.ode"\r\n0;x;z;"q"\r\n', "utf-8-sig")
    assert df.columns == ["id", "id.1", "Unnamed: 2", 'Ünï`c.ode"'] and sorted(map(tuple, df.collect())) == [(str(k), "x\r\ny", "z", "q") for k in range(4)]
    (tmp_path / "k.csv").write_bytes('번호,제목\n1,"한글,\n제목"\n'.encode("cp949"))
    df, facts = load_table(spark, str(tmp_path / "k.csv"))
    assert df.collect()[0].제목 == "한글,\n제목" and facts["encoding"] == "cp949" and facts["malformed"].get == {"malformed": 0}
    (tmp_path / "h.csv").write_text("id,title\n")
    assert read_delimited(spark, str(tmp_path / "h.csv"), "id,title\n", "utf-8")[0].collect() == []


def test_states_of_a_line():
    q = Quotes(",")
    for line, out, inside in [("", 0, 1), ("a,b", 0, 1), ('a,"b', 1, 0), ('"', 1, 0), ('a"b', 0, 0), ('""', 0, 1), ('"a\\"', 1, 0), ('x",y', 0, 0), ('x","y', 1, 1), ('","', 0, 1), ("a\\", 0, 1), ('\\",b', 0, 1)]:
        assert (q.after(line, False), q.after(line, True)) == (bool(out), bool(inside)), line
    assert column_names("a,a,,a\n", ",") == ["a", "a.1", "Unnamed: 2", "a.2"]
