"""Line-wise JSON: parse, filter by year, count and rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rillmap.functions.text import year_slice


def parse_lines(lines: DataFrame, malformed: str = "skip") -> DataFrame:
    """(value, parsed): one row for each line that is JSON; blank and broken lines go.

    A line that is no object goes too, or fails the job with malformed='raise'.
    """
    rows = lines.select(F.trim("value").alias("value")).where("value <> ''").withColumn("parsed", F.expr("try_parse_json(value)")).where("parsed is not null")
    is_object = F.expr("schema_of_variant(parsed) like 'OBJECT%'")
    if malformed == "raise":
        return rows.where(F.when(is_object, F.lit(True)).otherwise(F.raise_error(F.lit("a line is no JSON object")).cast("boolean")))
    return rows.where(is_object)


def line_year() -> Column:
    return year_slice(F.expr("coalesce(try_variant_get(parsed, '$.update_date', 'string'), '')"))


def lines_before(lines: DataFrame, cutoff: int, malformed: str = "skip") -> DataFrame:
    """Lines whose year is known and before `cutoff`."""
    return parse_lines(lines, malformed).withColumn("year", line_year()).where((F.col("year") >= 0) & (F.col("year") < cutoff))


def count_before(spark: SparkSession, path: str, cutoff: int, malformed: str = "skip") -> int:
    return lines_before(spark.read.text(path), cutoff, malformed).count()


def table_before(spark: SparkSession, path: str, cutoff: int, malformed: str = "raise") -> DataFrame:
    """The kept lines as a table: the schema is inferred from the file, values as text, and read in one pass more."""
    schema = spark.read.option("primitivesAsString", True).json(path).schema
    kept = lines_before(spark.read.text(path), cutoff, malformed)
    return kept.select(F.from_json("value", schema, {"primitivesAsString": "true"}).alias("r")).select("r.*")


def rewrite_before(spark: SparkSession, path: str, out: str, cutoff: int) -> int:
    """The kept lines written as text, unchanged; their number, observed while writing."""
    seen = Observation()
    lines_before(spark.read.text(path), cutoff).observe(seen, F.count(F.lit(1)).alias("n")).select("value").write.mode("overwrite").text(out)
    return seen.get["n"]


def to_csv(spark: SparkSession, path: str, out: str) -> tuple[int, str]:
    """JSON Lines as CSV; (rows, path)."""
    seen = Observation()
    df = spark.read.option("primitivesAsString", True).json(path)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(out)
    return seen.get["n"], out
