"""Samples and lookups of the step table, the same on every run and cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> Column:
    """A pseudo-random order that any engine with md5 can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


#: Rows up to which a plain top-n or a sort on one side is the better way; keys that
#: part the rows in one pass of a selection.
SMALL, PIVOTS = 10_000, 32


def _keyed(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.select(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("k"))


def key_at(df: DataFrame, keys: list[Column], position: int) -> tuple[Column, int, int] | None:
    """The key at a position (from 0) of the ascending order of ``keys``, as a struct, how
    many rows come before all rows of that key, and how many rows have it.

    A selection without a sort of all rows: keys of a small sample part the rows, one
    aggregation counts each part, and only the part with the position is looked at
    again, until it has at most SMALL rows or one key.  The driver gets a few
    thousand keys at most.  None beyond the last row.
    """
    rows = _keyed(df, keys)
    kind = rows.schema["k"].dataType

    def literal(key) -> Column:
        return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields, strict=True)))

    before, inside, seed = 0, rows.count(), 0
    if not 0 <= position < inside:
        return None
    while inside > SMALL:
        seed += 1
        drawn = [r["k"] for r in rows.sample(min(1.0, 64 * PIVOTS / inside), seed).orderBy("k").collect()]
        pivots = list(dict.fromkeys(drawn[len(drawn) // PIVOTS // 2 :: max(1, len(drawn) // PIVOTS)]))
        if not pivots:
            continue
        listed = F.array(*map(literal, pivots))
        slot = 2 * F.size(F.filter(listed, lambda p: p < F.col("k"))) + F.exists(listed, lambda p: p == F.col("k")).cast("int")
        counts = dict(rows.groupBy(slot.alias("slot")).count().collect())
        at = 0
        while position >= before + counts.get(at, 0):
            before += counts.get(at, 0)
            at += 1
        inside = counts[at]
        if at % 2:
            return literal(pivots[at // 2]), before, inside
        if at:
            rows = rows.where(F.col("k") > literal(pivots[at // 2 - 1]))
        if at // 2 < len(pivots):
            rows = rows.where(F.col("k") < literal(pivots[at // 2]))
    found = [r["k"] for r in rows.orderBy("k").collect()]
    key = found[position - before]
    return literal(key), before + found.index(key), found.count(key)


def first_n(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The n first rows (all, if there are fewer) in the order of ``keys``, in no order themselves.

    Few rows are a top-n.  More are a filter by the key at their end, which every
    task applies to its own rows; only rows of that one key are ranked, if not all fit.
    """
    if n <= SMALL:
        return df.orderBy(*keys).limit(max(n, 0))
    end = key_at(df, keys, n - 1)
    if end is None:
        return df
    key, before, ties = end
    own = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    if before + ties == n:
        return df.where(own <= key)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    tied = df.where(own == key).withColumn("__place", place).where(F.col("__place") <= n - before).drop("__place")
    return df.where(own < key).unionByName(tied)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), by a hash of the key."""
    return first_n(df, [hash_order(key, seed), F.col(key)], n)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """An exact share of the rows; costs one count more."""
    return sample_n(df, key, math.floor(df.count() * fraction + 0.5), seed)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def row_at(df: DataFrame, order: list[str], position: int) -> DataFrame:
    """The row at a position from 0 (below 0: from the end) of an order; no row beyond the ends.

    A table has no order of its own, so one must be given; ties may fall either way.
    Positions far from both ends are selected (:func:`key_at`), not sorted for.
    """
    near = position if position >= 0 else -position - 1
    if near < SMALL:
        keys = [F.col(c) for c in order] if position >= 0 else [F.desc(c) for c in order]
        return df.orderBy(*keys).offset(near).limit(1)
    keys = [F.col(c) for c in order]
    found = key_at(df, keys, position if position >= 0 else df.count() + position)
    return df.limit(0) if found is None else df.where(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))) == found[0]).limit(1)


def task(df: DataFrame, key: str, value) -> DataFrame:
    """A task's rows; the filter reaches the scan.  KeyError if there are none."""
    out = df.where(F.col(key) == value)
    if out.isEmpty():
        raise KeyError(value)
    return out


def task_of_row(df: DataFrame, row_key: str, row, task_key: str) -> DataFrame:
    """All rows of the task that one row belongs to."""
    return df.join(df.where(F.col(row_key) == row).select(task_key).distinct(), task_key, "left_semi")


def distinct_tasks(df: DataFrame, key: str, order: str) -> DataFrame:
    """Task ids in order of first appearance, nulls left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen", key)


def sample_view(df: DataFrame) -> DataFrame:
    """A step as the evaluators see it, with its origin in a struct."""
    return df.select(
        F.col("confirmed_task").alias("instruction"),
        F.col("pos_candidates").alias("candidates"),
        "operation", "screenshot", "cleaned_html",
        F.struct("annotation_id", "action_uid", "website", "domain").alias("metadata"),
    )
