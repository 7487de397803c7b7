"""Small result tables as files in an event: CSV text in base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.functions.text import base64_text

MIME = "text/csv; charset=utf-8"


def csv_field(c: Column) -> Column:
    """A value as CSV text: null is empty, quotes are doubled, what holds a comma, quote or line break is quoted."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_text(df: DataFrame, *order: Column) -> DataFrame:
    """One row (csv_text, content): a header and the rows of `df`, each with its line break, in `order`; content is its base64.

    Meant for reports, as it makes one value of the whole table. Numbers are written as Spark casts them. In a table of one column an
    empty value is written as two quotes, so that its row is no empty line. An empty table is its header alone.
    """
    one = len(df.columns) == 1
    fields = [F.when(csv_field(F.col(f"`{c}`")) == "", '""').otherwise(csv_field(F.col(f"`{c}`"))) if one else csv_field(F.col(f"`{c}`")) for c in df.columns]
    lines = df.select(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.concat_ws(",", *fields).alias("line")).alias("r"))
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in df.columns)
    rows = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(r["line"], F.lit("\n")))
    return lines.agg(F.concat(F.lit(header + "\n"), F.array_join(rows, "")).alias("csv_text")).select("csv_text", base64_text(F.col("csv_text")).alias("content"))


def csv_file(df: DataFrame, filename: str, *order: Column) -> dict[str, str]:
    """The table as a file for an event's outputs."""
    return {"filename": filename, "mime": MIME, "encoding": "base64", "content": csv_text(df, *order).first().content}
