"""A stream of JSON lines, filtered by year as it arrives."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillmap.sources.jsonl import lines_before


def stream_before(spark: SparkSession, folder: str, out: str, checkpoint: str, cutoff: int) -> StreamingQuery:
    """Append the kept lines of files that appear in `folder` to `out`; exactly once by the checkpoint folder."""
    lines = spark.readStream.text(folder)
    kept = lines_before(lines, cutoff).select("value")
    return kept.writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
