"""Excel workbooks, each read by the task that has it, from the file format itself."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates or times.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _text(node) -> str:
    """The text of a shared or inline string, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _place(reference: str) -> int:
    """The column of a cell reference, A is 0."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dates = _DATES | {k for k, code in own.items() if re.search("[ymdhs]", code.lower())}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _number(value: str, date: bool, since: datetime) -> str:
    """A number as text, whole ones without a point; a date in ISO form, with its time where it has one."""
    number = float(value)
    if date:
        moment = since + timedelta(seconds=round(number * 86400, 3))
        return moment.isoformat(sep=" ") if moment.time() != datetime.min.time() else moment.date().isoformat()
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet that have a value, cells at their columns; empty cells and error values are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        main = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[main.find(f"{_MAIN}sheets")[0].get(_LINK)]
        setting = main.find(f"{_MAIN}workbookPr")
        since = datetime(1904, 1, 1) if setting is not None and setting.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        dates = _date_styles(book)
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _place(cell.get("r")) if cell.get("r") else k
                    kind, value, inline = cell.get("t", "n"), cell.findtext(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                    if kind == "inlineStr":
                        said = _text(inline) if inline is not None else None
                    elif value is None or kind == "e":
                        said = None
                    elif kind == "s":
                        said = shared[int(value)]
                    elif kind == "b":
                        said = str(value == "1")
                    else:
                        said = _number(value, int(cell.get("s", 0)) in dates, since) if kind == "n" else value
                    out += [None] * (at + 1 - len(out))
                    out[at] = said or None
                row.clear()
                if any(x is not None for x in out):
                    yield out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of all workbooks at `path` as one table of text columns, named by the first one's first row.

    A workbook is read by one task, cell by cell; the driver gets the names alone. Rows may be shorter than the names, or longer:
    cells beyond them are left out. Dates are in ISO form. A workbook without a row gives no rows.
    """
    files = spark.read.format("binaryFile").load(path)

    def heads(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row := next(sheet_rows(data), None):
                    yield pa.record_batch([pa.array([name]), pa.array([row], pa.list_(pa.string()))], ["path", "names"])

    first = files.select("path", "content").mapInArrow(heads, "path string, names array<string>").orderBy("path").first()
    names = [n or f"Unnamed: {k}" for k, n in enumerate(first.names)] if first else []
    names = [n if n not in names[:k] else f"{n}.{names[:k].count(n)}" for k, n in enumerate(names)]
    internal = [f"c{k}" for k in range(len(names))]

    def read(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = sheet_rows(data)
                next(rows, None)
                while part := [r for _, r in zip(range(4096), rows, strict=False)]:
                    columns = [pa.array([r[k] if k < len(r) else None for r in part], pa.string()) for k in range(len(internal))]
                    yield pa.record_batch(columns, internal)

    if not names:
        return spark.createDataFrame([], "value string")
    table = files.select("content").mapInArrow(read, ", ".join(f"{n} string" for n in internal))
    return table.select(*(F.col(i).alias(n) for i, n in zip(internal, names, strict=True)))
