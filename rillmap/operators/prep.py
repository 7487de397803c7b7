"""Years, cleaning and keyword filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.config import KEYWORDS, YEAR_COLUMNS
from rillmap.functions.text import text_value, year_slice

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "yyyyMM", "d MMM yyyy HH:mm:ss z", "d MMM yyyy")


def year_candidates(df: DataFrame) -> list[str]:
    """Date columns by name: the known ones first, then any that sounds like a date."""
    known = [c for c in YEAR_COLUMNS if c in df.columns]
    return known + [c for c in df.columns if c not in known and any(w in c.lower() for w in ("date", "time", "publish"))]


def _parsed_year(c: str) -> Column:
    return F.year(F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.col(c).cast("string"), "^[A-Za-z]{3}, ", ""), F.lit(f)) for f in FORMATS], F.col(c).try_cast("timestamp")))


def derive_year(df: DataFrame) -> DataFrame:
    """`df` with an integer `year`, -1 where none can be read.

    An existing year is read by its first four characters. Otherwise the first date column of which any value
    parses decides, then the first whose characters begin with a year; one aggregate probes them all.
    """
    if "year" in df.columns:
        return df.withColumn("year", year_slice(F.col("year")))
    names = year_candidates(df)
    if not names:
        return df.withColumn("year", F.lit(-1))
    probe = df.agg(*[F.bool_or(_parsed_year(c).isNotNull()).alias(f"p{k}") for k, c in enumerate(names)], *[F.bool_or(year_slice(F.col(c)) >= 0).alias(f"s{k}") for k, c in enumerate(names)]).first()
    for k, c in enumerate(names):
        if probe[f"p{k}"]:
            return df.withColumn("year", F.coalesce(_parsed_year(c), F.lit(-1)))
    for k, c in enumerate(names):
        if probe[f"s{k}"]:
            return df.withColumn("year", year_slice(F.col(c)))
    return df.withColumn("year", F.lit(-1))


def before_year(df: DataFrame, cutoff: int, drop_unknown: bool = False) -> DataFrame:
    """Rows of years before `cutoff`; unknown years (-1) stay unless told otherwise."""
    out = derive_year(df).where(F.col("year") < cutoff)
    return out.where("year >= 0") if drop_unknown else out


def clean_nonempty(df: DataFrame, literal_nulls: bool = False) -> DataFrame:
    """Title and abstract as text; rows where every one of them is empty go, white space counts as text."""
    own = [c for c in ("title", "abstract") if c in df.columns]
    out = df.withColumns({c: text_value(F.col(c), literal_nulls) for c in own})
    if not own:
        return out
    full = F.lit(False)
    for c in own:
        full = full | (F.length(c) > 0)
    return out.where(full)


def keyword_filter(df: DataFrame, keywords: Sequence[str] = KEYWORDS, text_cols: Sequence[str] = ("title", "abstract"), ignore_case: bool = True, regex: bool = False) -> DataFrame:
    """Rows whose joined text holds any keyword as a substring or matches any pattern; no keyword or column: all rows."""
    own = [c for c in text_cols if c in df.columns]
    if not keywords or not own:
        return df
    text = F.trim(F.concat_ws(" ", *[F.col(c).cast("string") for c in own]))
    hit = F.lit(False)
    for k in keywords:
        if regex:
            hit = hit | text.rlike(("(?i)" if ignore_case else "") + k)
        else:
            hit = hit | (F.lower(text).contains(k.lower()) if ignore_case else text.contains(k))
    return df.where(hit)


def preprocess(df: DataFrame, keywords: Sequence[str] = KEYWORDS, literal_nulls: bool = False) -> DataFrame:
    return derive_year(df).transform(clean_nonempty, literal_nulls).transform(keyword_filter, keywords)
