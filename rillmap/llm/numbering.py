"""Row numbers over whole tables and within groups of any size, without a group or the table in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def numbered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`df` with idx (from 0, in `order` within each group) and n (the group's rows), as a checkpoint.

    Rows are dealt in ranges of (group, order), so a large group lies in many ranges; row_number counts within each
    range and group, and a table of one row for each (range, group) says how many rows of the group come before.
    Rows that are equal in all of these are told apart by the place where they were read, so they too are spread, and
    which of them comes first does not matter. Null groups are groups. `df` must have no columns tie, part, idx, n.
    """
    tied = materialize(df.withColumn("tie", F.monotonically_increasing_id()))
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order, F.col("tie")]
    ranged = materialize(tied.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    local = ranged.withColumn("idx", F.row_number().over(Window.partitionBy("part", *group).orderBy(*keys[len(group) :])).cast("long") - 1)
    pieces = ranged.groupBy("part", *group).agg(F.count("*").alias("rows"))
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # ungrouped: a row for each range
    earlier = F.coalesce(F.sum("rows").over(across.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("part").alias("_part"), *(F.col(g).alias(f"_{g}") for g in group), earlier.alias("_before"), F.sum("rows").over(across).alias("n"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("part") == F.col("_part"))
    found = local.join(pieces, same).withColumn("idx", F.col("idx") + F.col("_before"))
    return materialize(found.select(*df.columns, "idx", "n"))
