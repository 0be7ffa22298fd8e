"""Totals of a run that grows: one small state row for each batch and group, merged when read.

Counts and sums add up; times go into a KLL sketch, so a median over all batches
needs no earlier row again.  States are Parquet, by run and batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ratio

#: Size of a sketch: the rank of a quantile is off by about 1 % (99 of 100 times).
SIZE = 400


def state(df: DataFrame, keys: list[str], flags: tuple[str, ...] = (), time: str | None = None, size: int = SIZE) -> DataFrame:
    """Per group: total, one count a flag and, with a time column, its sum, count and sketch.

    Null flags count as false, null times are left out.
    """
    timed = [F.sum(F.col(time).cast("double")).alias("time_sum"), F.count(time).alias("time_count"), F.kll_sketch_agg_double(F.col(time).cast("double"), F.lit(size)).alias("time_sketch")] if time else []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(f).alias(f"{f}_count") for f in flags), *timed)


def add_batch(states: DataFrame, path: str, run_id: str, batch: str) -> None:
    """Adds a batch's states to a run; the same batch again replaces itself."""
    named = states.withColumns({"run_id": F.lit(run_id), "batch": F.lit(batch)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch").parquet(path)


def states_of(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """All states of a run; the filter prunes folders."""
    return spark.read.parquet(path).where(F.col("run_id").cast("string") == run_id).drop("run_id", "batch")


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of many batches as one for each group, of the same columns."""
    counts = [F.sum(c).alias(c) for c in states.columns if c == "total" or c.endswith(("_count", "_sum"))]
    sketch = [F.kll_merge_agg_double("time_sketch").alias("time_sketch")] if "time_sketch" in states.columns else []
    return states.groupBy(*keys).agg(*counts, *sketch)


def rates(states: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Merged states as rates, mean time and quantiles; groups without a time have none."""
    flags = [c.removesuffix("_count") for c in states.columns if c.endswith("_count") and c != "time_count"]
    out: list[Column] = [ratio(F.col(f"{f}_count"), F.col("total")).alias(f"{f}_rate") for f in flags]
    if "time_sketch" in states.columns:
        some = F.col("time_count") > 0
        out.append(F.when(some, F.try_divide("time_sum", "time_count")).alias("mean_time"))
        out += [F.when(some, F.kll_sketch_get_quantile_double("time_sketch", F.lit(q))).alias(f"time_{round(q * 100)}") for q in quantiles]
    return states.select(*(c for c in states.columns if not c.startswith("time_")), *out)
