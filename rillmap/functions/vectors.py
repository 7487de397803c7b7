"""Vector expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def parse_vector(c: Column) -> Column:
    """A vector from JSON text or a bracketed literal; null if it is none or if a component is no number."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\(", "["), r",?\s*\)$", "]")
    found = F.from_json(text, "array<double>")
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def usable_vector(df: DataFrame, name: str) -> Column:
    """The vector of an array or text column; null where it is empty or a component is null or not finite."""
    v = F.col(name)
    v = parse_vector(v) if isinstance(df.schema[name].dataType, StringType) else v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(v) > 0) & ~bad, v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def divided(a: Column, by: Column) -> Column:
    """The vector divided by a number, which is bound first: within the inner function it would be reckoned for each component."""
    bound = F.array(F.struct(a.alias("a"), by.alias("by")))
    return F.transform(bound, lambda s: F.transform(s["a"], lambda x: x.cast("double") / s["by"]))[0]


def l2(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    n = norm(a)
    return divided(a, F.when(n > 0, n).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
