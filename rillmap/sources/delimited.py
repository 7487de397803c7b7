"""Delimited text with quoted fields, read by as many tasks as it has splits."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SEPARATORS = ",;\t|"


def sniff_separator(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head[:20000], delimiters=SEPARATORS).delimiter
    except csv.Error:
        return ","


def parse(records: list[str], sep: str) -> Iterator[list[str] | None]:
    """The fields of each record: quotes are doubled or escaped by a backslash; None for one that cannot be read."""
    csv.field_size_limit((1 << 31) - 1)
    for record in records:
        try:
            yield next(csv.reader([record], delimiter=sep, quotechar='"', escapechar="\\"), [])
        except csv.Error:
            yield None


def column_names(head: str, sep: str) -> list[str]:
    """The names in the first record; a name that comes again is numbered (`a.1`), an absent one says its place."""
    first = next((r for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep, quotechar='"', escapechar="\\") if r), [])
    names: list[str] = []
    for k, own in enumerate(first):
        own = own or f"Unnamed: {k}"
        name, again = own, 0
        while name in names:
            again += 1
            name = f"{own}.{again}"
        names.append(name)
    return names


class Quotes:
    """Where a line leaves the reader: inside a quoted field or not, from either state at its start.

    A quote opens a field only at the field's start; elsewhere in a bare field it is a letter.
    """

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.quoted = re.compile(r'(?:[^"\\]|\\.|"")*+(?:\\\Z)?', re.DOTALL)
        self.bare = re.compile(rf"(?:[^{s}\\]|\\.)*+(?:\\\Z)?", re.DOTALL)

    def after(self, line: str, inside: bool) -> bool:
        at, end = 0, len(line)
        while True:
            if not inside and at < end and line[at] == '"':
                inside, at = True, at + 1
            if inside:
                at = self.quoted.match(line, at).end()
                if at >= end:
                    return True
                inside, at = False, at + 1  # the closing quote; what follows it belongs to the field
            at = self.bare.match(line, at).end()
            if at >= end:
                return False
            at += 1


@dataclass
class Split:
    """What one pass finds of a split, for either state at its start (0: outside, 1: inside a quoted field)."""

    ends: list[bool] = field(default_factory=lambda: [False, True])
    #: The line where the record that is open just now began; -1: none is open, -2: it began before the split.
    open: list[int] = field(default_factory=lambda: [-1, -2])
    #: Lines up to and with the one that ends the record open at the start.
    head: int = 0
    lines: int = 0

    def take(self, line: str, quotes: Quotes) -> None:
        for start in (0, 1):
            was, now = self.ends[start], quotes.after(line, self.ends[start])
            if self.open[start] == -2 and not now:
                self.head = self.lines + 1
            if not now:
                self.open[start] = -1
            elif not was:
                self.open[start] = self.lines
            self.ends[start] = now
        self.lines += 1


def _by_split(batches) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """((file, first byte), lines) of stretches of rows from one split."""
    for batch in batches:
        files, starts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(files)], strict=True):
            if lo < hi:
                yield (int(files[lo]), int(starts[lo])), batch.column(0).slice(lo, hi - lo)


def _quoted(lines: pa.Array) -> list[int]:
    """Places of the lines with a quote: the others leave the state as it is."""
    return pc.indices_nonzero(pc.match_substring(lines, b'"')).to_pylist()


def _text(line: bytes, encoding: str) -> str:
    return line.decode(encoding, "replace")


def _find_states(batches, sep: str, encoding: str):
    """A row for each split: its place and what Split says."""
    quotes, found = Quotes(sep), {}
    for key, lines in _by_split(batches):
        split = found.setdefault(key, Split())
        done = 0
        for k in _quoted(lines):
            split.lines += k - done
            split.take(_text(lines[k].as_py(), encoding), quotes)
            done = k + 1
        split.lines += len(lines) - done
    rows = [(*key, s.ends, s.open, s.head if s.open[1] != -2 else s.lines) for key, s in found.items()]
    if rows:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "ends", "open", "head"])


@dataclass
class Place:
    """What a split has to do: its lines before `head` are a piece of the record `own`, those from `tail` on begin `after`."""

    head: int = 0
    tail: int = -1
    own: str = ""
    nth: int = 0
    after: str = ""


def _plan(rows) -> dict[tuple[int, int], Place]:
    """The true states, in the order of the splits: from each, the next one's follows."""
    plan, before, file, inside, record, nth = {}, None, None, False, "", 0
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        if r.file != file:
            if before:
                before.tail = -1  # what is open at the end of a file ends there
            file, inside = r.file, False
        here = Place()
        if inside:
            nth += 1
            here.own, here.nth, here.head = record, nth, r.head
        began = r.open[int(inside)]
        if began >= 0:
            record, nth = f"{r.file}:{r.start}", 0
            here.tail, here.after = began, record
        inside = r.ends[int(inside)]
        plan[r.file, r.start] = before = here
    if before:
        before.tail = -1
    return plan


def _rows(records: list[str], sep: str, names: list[str]) -> pa.RecordBatch:
    """A row for each record that is not an empty line; one with too many fields is malformed."""
    out = []
    for fields in parse(records, sep):
        if fields is None or len(fields) > len(names):
            out.append((*[None] * len(names), True))
        elif fields:
            out.append((*(x or None for x in fields), *[None] * (len(names) - len(fields)), False))
    columns = list(zip(*out, strict=True)) or [()] * (len(names) + 1)
    return pa.record_batch([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.bool_())], [*names, "malformed"])


def _located(batches, plan: dict[tuple[int, int], Place]):
    """(split, its place, lines of it before these, lines) as long as the splits are those that were planned for."""
    seen: dict[tuple[int, int], int] = {}
    for key, lines in _by_split(batches):
        if key not in plan:
            raise RuntimeError("the file is split otherwise than when it was opened: open it again")
        yield key, plan[key], seen.get(key, 0), lines
        seen[key] = seen.get(key, 0) + len(lines)


def _between(n: int, done: int, at: int) -> int:
    return max(0, min(n, at - done))


def _read(batches, plan, sep: str, encoding: str, names: list[str]):
    """The rows of all records that lie whole in a split."""
    quotes, header, last = Quotes(sep), set(), None
    open_: list[str] = []
    for key, place, done, lines in _located(batches, plan):
        if key != last and open_:
            yield _rows(["\n".join(open_)], sep, names)
            open_ = []
        last = key
        lo, hi = _between(len(lines), done, place.head), len(lines) if place.tail < 0 else _between(len(lines), done, place.tail)
        lines = lines.slice(lo, max(0, hi - lo))
        texts, records, at = [_text(x, encoding) for x in lines.to_pylist()], [], 0
        for k in _quoted(lines):
            (open_ if open_ else records).extend(texts[at:k])
            inside = quotes.after(texts[k], bool(open_))
            open_.append(texts[k])
            if not inside:
                records.append("\n".join(open_))
                open_ = []
            at = k + 1
        (open_ if open_ else records).extend(texts[at:])
        if key[1] == 0 and key not in header:  # a file's first record that is not empty has the names
            while records and not records[0].strip("\r"):
                records.pop(0)
            if records:
                records.pop(0)
                header.add(key)
        if records:
            yield _rows(records, sep, names)
    if open_:
        yield _rows(["\n".join(open_)], sep, names)


def _pieces(batches, plan, encoding: str):
    """The pieces of the records that lie across splits: (record, split, line, text)."""
    for _, place, done, lines in _located(batches, plan):
        n = len(lines)
        lo, hi = _between(n, done, place.head), n if place.tail < 0 else _between(n, done, place.tail)
        for record, nth, a, b in ((place.own, place.nth, 0, lo), (place.after, 0, hi, n)):
            if a < b:
                text = "\n".join(_text(x, encoding) for x in lines.slice(a, b - a).to_pylist())
                yield pa.record_batch([pa.array([record]), pa.array([nth]), pa.array([done + a]), pa.array([text])], ["record", "split", "line", "text"])


def read_delimited(spark: SparkSession, path: str, head: str, encoding: str = "utf-8") -> tuple[DataFrame, dict]:
    """(table of text columns, facts): `sep`, and `malformed`, an Observation of the rows left out, filled by the first action.

    One pass finds, for every split and either state at its start, whether it ends inside a quoted field and where
    the records that it cuts begin and end; put together in order (a row for each split, on the driver) this gives every split its true
    state. The read is a second pass in which each task parses the whole records of its splits. Only where a record
    lies across splits, its pieces are read in a further pass and put together. So a file with quoted line breaks is
    split like any other.

    Rows with more fields than the header has names are malformed and left out, shorter ones are filled with nulls;
    both are decided on the whole record, so the rows are the same whatever columns are read. Empty fields are null,
    empty lines are none. Bytes that the encoding cannot read become its replacement mark. Line breaks in quotes stay as they are.
    """
    head = head.removeprefix("\ufeff")
    sep = sniff_separator(head)
    names = column_names(head, sep)
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    coding = "utf-8-sig" if encoding.startswith("utf-8") else encoding
    plan = _plan(lines.mapInArrow(lambda x: _find_states(x, sep, coding), "file long, start long, ends array<boolean>, open array<long>, head long").collect())
    internal = [f"c{k}" for k in range(len(names))]
    kind = ", ".join([*(f"{n} string" for n in internal), "malformed boolean"])
    table = lines.mapInArrow(lambda x: _read(x, plan, sep, coding, internal), kind)
    if any(place.own for place in plan.values()):
        pieces = lines.mapInArrow(lambda x: _pieces(x, plan, coding), "record string, split long, line long, text string")
        ordered = F.array_sort(F.collect_list(F.struct("split", "line", "text")))
        cut = pieces.groupBy("record").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text")).select("text")
        table = table.unionByName(cut.mapInArrow(lambda x: (_rows(b.column(0).to_pylist(), sep, internal) for b in x), kind))
    malformed = Observation()
    table = table.observe(malformed, F.count_if("malformed").alias("malformed")).where("not malformed")
    return table.select(*(F.col(i).alias(n) for i, n in zip(internal, names, strict=True))), {"sep": sep, "malformed": malformed}
