"""Cutting the plan of iterative operators."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names (a temporary one where all is one machine)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession, rounds: int = 3) -> None:
    """Let Spark's cleaner delete the files of shuffles and checkpoints that nothing refers to any more."""
    for k in range(rounds):  # what holds on to a shuffle is itself collected a moment after the first round
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5 if k + 1 < rounds else 0)
