"""Text and year expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.config import EMBED_TEXT_COLUMNS, NAME_ALIASES, NAME_KEYS, STOP_WORDS, TITLE_COLUMNS, TOKEN_PATTERN


def year_slice(c: Column) -> Column:
    """The first four characters as a number if all are digits (fewer pass too), else -1."""
    head = F.substring(c.cast("string"), 1, 4)
    return F.when(head.rlike("^[0-9]{1,4}$"), head.try_cast("int")).otherwise(F.lit(-1))


def text_value(c: Column, literal_nulls: bool = False) -> Column:
    """A column as text; null is empty, or the literal 'nan' where the old behaviour is wanted."""
    return F.coalesce(c.cast("string"), F.lit("nan" if literal_nulls else ""))


def joined_text(columns: Sequence[str]) -> Column:
    """Columns joined by one space, nulls empty, not trimmed."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def trimmed_text(columns: Sequence[str]) -> Column:
    """Non-null columns joined by one space and trimmed."""
    return F.trim(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def clean_words(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased ASCII words of three letters or more, without stop words, joined by spaces."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words, " ")


def tokens(c: Column) -> Column:
    """Lower-cased tokens of two characters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def ngrams(words: Column) -> Column:
    """Unigrams and bigrams; bigrams join neighbours that remain after stop words have gone."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def shortened(c: Column, length: int) -> Column:
    """Text of `length` characters at most, with an ellipsis where it was longer; null is empty."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(F.coalesce(c, F.lit("")))


def naming_prompt(keywords: Column, titles: Column) -> Column:
    """A user prompt from 40 keywords and five titles of 90 characters at most."""
    return F.concat(
        F.lit("Keywords: "), F.array_join(F.slice(keywords, 1, 40), ", "),
        F.lit("\nTitles: "), F.array_join(F.transform(F.slice(titles, 1, 5), lambda t: shortened(t, 90)), "; "),
    )


def base64_text(c: Column) -> Column:
    """Base64 of the UTF-8 bytes, on one line."""
    return F.regexp_replace(F.base64(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), r"\s", "")


def normalized_names(m: Column) -> list[Column]:
    """The six name fields from a map of answers: own key, then its aliases in fixed order, else empty."""
    return [F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in (key, *NAME_ALIASES[key])], F.lit("")).alias(key) for key in NAME_KEYS]


def pick_embed_text(df: DataFrame, candidates: Sequence[str] = EMBED_TEXT_COLUMNS) -> Column:
    """The first candidate column, null as empty; without one all columns joined by ' | '."""
    for c in candidates:
        if c in df.columns:
            return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in df.columns])


def pick_text_columns(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """Columns for term statistics: the caller's, else the first title column, else the first two text columns."""
    own = [c for c in wanted or () if c in df.columns]
    title = [c for c in TITLE_COLUMNS if c in df.columns][:1]
    return own or title or [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name != "embedding"][:2]
