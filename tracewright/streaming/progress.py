"""The same metrics over a stream of step records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import task_metrics


def running_task_metrics(steps: DataFrame, key: str = "action_uid", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Task metrics of a streaming step table, each record counted once.

    With an event time, state older than ``late`` is dropped by its watermark.
    """
    once = steps.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else steps.dropDuplicates([key])
    return task_metrics(once)


def windowed_failures(steps: DataFrame, ts: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Failed steps and their share per window of event time."""
    return steps.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("step_success")).alias("failed")).withColumn("share", F.col("failed") / F.col("steps"))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes a rerun skip it."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def drain_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
