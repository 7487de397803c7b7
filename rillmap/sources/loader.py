"""Tables from files of unknown format: JSON Lines, JSON, delimited text, Parquet, Excel."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from rillmap.config import JSON_ROOTS
from rillmap.sources.delimited import read_delimited
from rillmap.sources.workbook import read_workbooks

HEAD = 100_000
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")


def looks_like_json(text: str) -> bool:
    return text.lstrip()[:1] in ("{", "[")


def looks_like_jsonl(text: str) -> bool:
    """Two lines or more, the first five of which all begin an object or array."""
    lines = [x for x in (line.strip() for line in text.splitlines()) if x][:5]
    return len(lines) > 1 and all(x[0] in "{[" for x in lines)


def sniff_encoding(head: bytes) -> str:
    """The first encoding that reads the head; a character cut off at its end does not count against it."""
    for name in ENCODINGS:
        for cut in range(4):
            try:
                head[: len(head) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                if len(head) < HEAD:
                    break
    return "latin-1"


def file_head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file (of a folder, its first file), read by Hadoop from wherever it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(place).isDirectory():
        files = sorted(s.getPath().toString() for s in fs.listStatus(place) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        place = hadoop.Path(files[0])
    stream = fs.open(place)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(kind: StructType, path: str, name: str):
        for f in kind.fields:
            own, label = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, own, label)
            else:
                yield F.col(own).alias(label)

    return df.select(*leaves(df.schema, "", ""))


def charset(encoding: str) -> dict[str, str]:
    """Reader options for an encoding; the Korean ones have other names in Java."""
    if encoding.startswith("utf-8"):
        return {"encoding": "UTF-8"}
    return {"encoding": {"cp949": "x-windows-949", "latin-1": "ISO-8859-1"}.get(encoding, encoding)}


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark reads but a few charsets unless told otherwise."""
    if encoding in ("cp949", "euc-kr"):
        spark.conf.set("spark.sql.legacy.javaCharsets", True)


def read_jsonl(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """JSON Lines; ids and years keep their text, malformed lines go."""
    allow_charset(spark, encoding)
    return spark.read.options(primitivesAsString=True, mode="DROPMALFORMED", lineSep="\n", **charset(encoding)).json(path)


def read_json(spark: SparkSession, path: str, encoding: str = "utf-8") -> tuple[DataFrame, str]:
    """(table, shape): an array of rows, rows below a known root key, or one object flattened to a row."""
    allow_charset(spark, encoding)
    df = spark.read.options(multiLine=True, primitivesAsString=True, **charset(encoding)).json(path)
    one_object = file_head(spark, path).decode(encoding, "ignore").lstrip()[:1] == "{"
    for key in JSON_ROOTS:
        if one_object and key in df.columns and isinstance(df.schema[key].dataType, ArrayType):
            rows = df.select(F.explode(key).alias("r"))
            return (rows.select("r.*") if isinstance(rows.schema["r"].dataType, StructType) else rows), f"json:{key}"
    if one_object:
        return flatten(df), "json:object"
    return df, "json:array"


def load_table(spark: SparkSession, path: str, prefer_jsonl: bool = False) -> tuple[DataFrame, dict]:
    """(table, facts with `format`), by extension and content: Excel, Parquet, JSON Lines, JSON, delimited text."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".xlsx":
        return read_workbooks(spark, path), {"format": "excel"}
    if kind == ".xls":
        raise ValueError("the old binary workbooks are not read: save them as .xlsx")
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path), {"format": "parquet"}
    raw = file_head(spark, path)
    encoding = sniff_encoding(raw)
    head = raw.decode(encoding, "ignore")
    if prefer_jsonl or looks_like_jsonl(head) and not _one_document(head):
        return read_jsonl(spark, path, encoding), {"format": "jsonl", "encoding": encoding}
    if looks_like_json(head):
        df, shape = read_json(spark, path, encoding)
        return df, {"format": shape, "encoding": encoding}
    if kind == ".jsonl":
        return read_jsonl(spark, path, encoding), {"format": "jsonl", "encoding": encoding}
    df, facts = read_delimited(spark, path, head, encoding)
    return df, {"format": "csv", "encoding": encoding, **facts}


def _one_document(head: str) -> bool:
    """True where the first line is no whole JSON value, so that lines are parts of one document."""
    first = next((x for x in head.splitlines() if x.strip()), "")
    try:
        json.loads(first)
        return False
    except ValueError:
        return True


def save_table(df: DataFrame, path: str) -> str:
    """Parquet for .parquet and .pq, CSV for .csv; any other ending becomes .parquet. The path written to."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return path
    path = path if kind in (".parquet", ".pq") else f"{path}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path

