"""Confidence intervals of rates by a Poisson bootstrap over tasks.

Steps of one task depend on each other, so tasks are drawn, not steps.  A replicate
gives each task a Poisson(1) weight made from a hash of its id: any engine and any
partitioning draws the same, and a task's weight needs no other row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ratio

#: Replicates that share one hash, as eight hexadecimal digits each.
SHARE = 4


def thresholds(size: int = 2**32) -> list[int]:
    """The hash values from which a Poisson(1) weight is 1, 2, ... (as far as ``size`` tells them apart)."""
    out, total = [], 0.0
    for k in range(20):
        total += math.exp(-1) / math.factorial(k)
        at = round(total * size)
        if at >= size:
            break
        out.append(at)
    return out


def weight(digits: Column) -> Column:
    """A Poisson(1) weight of eight hexadecimal digits."""
    u = F.conv(digits, 16, 10).cast("long")
    return sum(((u >= t).cast("int") for t in thresholds()), F.lit(0))


def replicates(df: DataFrame, key: str, parts: dict[str, tuple[Column, Column]], n: int = 200, seed: int = 42) -> DataFrame:
    """replicate (0 .. n-1, and -1 for all tasks as they are) and, for each name of
    ``parts``, its rate in that replicate.

    ``parts`` holds aggregate columns (part, whole) of a task's rows, both whole
    numbers.  Rows are summed by task once (one shuffle); what the replicates add is
    summed where the tasks stand, so a partition gives n+1 rows, however many tasks it
    has.  A null key is a task like any other.
    """
    tasks = df.groupBy(key).agg(*(c.cast("long").alias(f"{side}_{k}") for k, pair in enumerate(parts.values()) for side, c in zip(("part", "whole"), pair, strict=True)))
    text = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)), F.col("block").cast("string"))
    drawn = tasks.select("*", F.explode(F.sequence(F.lit(-1), F.lit((n - 1) // SHARE))).alias("block")).withColumn("digits", F.md5(text))
    some = F.array(*(F.struct((F.col("block") * SHARE + k).alias("replicate"), weight(F.substring("digits", 8 * k + 1, 8)).alias("w")) for k in range(SHARE)))
    every = F.array(F.struct(F.lit(-1).alias("replicate"), F.lit(1).alias("w")))
    rows = drawn.select(*(c for c in tasks.columns if c != key), F.explode(F.when(F.col("block") < 0, every).otherwise(some)).alias("r")).where((F.col("r.w") > 0) & (F.col("r.replicate") < n))
    sums = [F.sum(F.col(f"{side}_{k}") * F.col("r.w")).alias(f"{side}_{k}") for k in range(len(parts)) for side in ("part", "whole")]
    return rows.groupBy(F.col("r.replicate").alias("replicate")).agg(*sums).select("replicate", *(ratio(F.col(f"part_{k}"), F.col(f"whole_{k}")).alias(name) for k, name in enumerate(parts)))


def intervals(df: DataFrame, key: str, parts: dict[str, tuple[Column, Column]], level: float = 0.95, n: int = 200, seed: int = 42) -> DataFrame:
    """One row for each rate: metric, estimate, low, high.

    Low and high are the ends of the middle ``level`` of the replicates' rates, by
    rank.  Replicates in which no task was drawn are left out; without rows there is
    an estimate of 0 and no interval.
    """
    everything, tail = F.col("replicate") < 0, (1 - level) / 2
    held = replicates(df, key, parts, n, seed).agg(  # n numbers for each rate
        *(F.coalesce(F.max(F.when(everything, F.col(name))), F.lit(0.0)).alias(f"{name}_all") for name in parts),
        *(F.sort_array(F.collect_list(F.when(~everything, F.col(name)))).alias(name) for name in parts),
    )

    def line(name: str) -> Column:
        size = F.size(name)
        low, high = F.floor(size * tail + 1e-9), F.ceil(size * (1 - tail) - 1e-9) - 1
        return F.struct(F.lit(name).alias("metric"), F.col(f"{name}_all").alias("estimate"), F.get(name, low.cast("int")).alias("low"), F.get(name, high.cast("int")).alias("high"))

    return held.select(F.explode(F.array(*map(line, parts))).alias("m")).select("m.*")
