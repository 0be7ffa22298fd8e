"""Aggregates at step, task, action-type and corpus level.

All are partial aggregations on flags; only per-task ones shuffle, once, by task.
"Operation F1" is plain accuracy in this data model, and values of steps that type
nothing count as right, so that metric is diluted on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ratio

ACTION_FLAGS = ("action_match", "target_match", "value_match", "overall_match")
STEP_FLAGS = {"element_accuracy": "element_match", "operation_accuracy": "operation_match", "value_accuracy": "value_match", "step_success_rate": "step_success"}


def _count() -> Column:
    return F.count(F.lit(1))


def action_accuracy(df: DataFrame) -> DataFrame:
    """One row: total and the three accuracies; zeros for no rows."""
    names = {"action_accuracy": "action_match", "target_accuracy": "target_match", "value_accuracy": "value_match"}
    return df.agg(_count().alias("total"), *(ratio(F.count_if(f), _count()).alias(k) for k, f in names.items()))


def by_action_type(df: DataFrame, key: str = "oracle_action_type") -> DataFrame:
    """Per true action type: total, correct counts and accuracies of all four flags."""
    counts = [F.count_if(f).alias(f"{f}_count") for f in ACTION_FLAGS]
    return df.groupBy(key).agg(_count().alias("total"), *counts, *(ratio(F.count_if(f), _count()).alias(f"{f}_rate") for f in ACTION_FLAGS))


def with_noop_fill(oracle: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every oracle row with its prediction; a missing one counts as noop."""
    noop = F.struct(F.lit("noop").alias("action_type"), F.lit(None).cast(predictions.schema["predicted"].dataType["target"].dataType).alias("target"), F.lit(None).cast("string").alias("value"))
    return oracle.join(predictions.select(key, "predicted"), key, "left").withColumn("predicted", F.coalesce("predicted", noop))


def task_metrics(steps: DataFrame, task: str = "annotation_id", meta: tuple[str, ...] = ()) -> DataFrame:
    """Per task: steps, four rates, offline0 (no failed step) and offline1 (at most
    one, so a task of one step always passes); ``meta`` from the first step."""
    failed = _count() - F.count_if("step_success")
    return steps.groupBy(task).agg(
        _count().alias("total_steps"),
        *(ratio(F.count_if(f), _count()).alias(k) for k, f in STEP_FLAGS.items()),
        (failed == 0).alias("offline0"),
        (failed <= 1).alias("offline1"),
        *(F.min_by(m, "step_index").alias(m) for m in meta),
    )


def corpus_metrics(steps: DataFrame, task: str = "annotation_id") -> DataFrame:
    """One row: micro averages over all steps, and task success rates.

    The tasks are aggregated once, keeping counts, and summed again: two levels,
    one shuffle.
    """
    per_task = steps.groupBy(task).agg(_count().alias("n"), *(F.count_if(f).alias(f) for f in STEP_FLAGS.values()))
    failed = F.col("n") - F.col("step_success")
    n = F.coalesce(F.sum("n"), F.lit(0))
    return per_task.agg(
        n.alias("total_steps"),
        _count().alias("total_tasks"),
        *(ratio(F.sum(f), n).alias(k) for k, f in STEP_FLAGS.items()),
        ratio(F.count_if(failed == 0), _count()).alias("offline0_rate"),
        ratio(F.count_if(failed <= 1), _count()).alias("offline1_rate"),
    )


def nested_steps(steps: DataFrame, task: str = "annotation_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """Per task its steps as a list of structs in order (bounded by a task's length)."""
    return steps.groupBy(task).agg(F.sort_array(F.collect_list(F.struct("step_index", *columns))).alias("steps"))


def failures(df: DataFrame, flag: str = "overall_match", limit: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose flag is false; with a limit, the first in order.

    A flag of neither evaluator, or that the table lacks, is read as the table's own
    verdict on the whole step.
    """
    known = flag in (*ACTION_FLAGS, *STEP_FLAGS.values()) and flag in df.columns
    out = df.where(~F.coalesce(F.col(flag if known else "overall_match" if "overall_match" in df.columns else "step_success"), F.lit(False)))
    return out.orderBy(*order).limit(limit) if limit else out


def all_succeeded(flag: Column) -> Column:
    return F.coalesce(F.bool_and(flag), F.lit(True))


def latency(df: DataFrame, keys: list[str], column: str = "latency") -> DataFrame:
    """Calls, total, mean and median time."""
    return df.groupBy(*keys).agg(_count().alias("calls"), F.sum(column).alias("total_latency"), F.avg(column).alias("mean_latency"), F.percentile_approx(column, 0.5).alias("median_latency"))


def by_task_length(tasks: DataFrame, edges: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """Success by number of steps, in ranges that end at ``edges``."""
    bucket = F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        bucket = F.when(F.col("total_steps") <= e, f"<={e}").otherwise(bucket)
    return tasks.groupBy(bucket.alias("length")).agg(_count().alias("tasks"), F.avg(F.col("offline0").cast("int")).alias("offline0_rate"))


def by_confidence(df: DataFrame, confidence: Column, flag: str, buckets: int = 10) -> DataFrame:
    """Accuracy by confidence range."""
    at = F.least(F.floor(confidence * buckets), F.lit(buckets - 1)).cast("int")
    return df.groupBy(at.alias("bucket")).agg(_count().alias("total"), ratio(F.count_if(flag), _count()).alias("accuracy"))


def robustness_drop(original: DataFrame, perturbed: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(original - perturbed) / original of a metric in two runs' aggregates."""
    joined = original.select(*keys, F.col(metric).alias("original")).join(perturbed.select(*keys, F.col(metric).alias("perturbed")), keys)
    return joined.withColumn("drop", F.try_divide(F.col("original") - F.col("perturbed"), F.col("original")))


def correction_rate(said: Column, corrected: Column) -> Column:
    """Share of predictions that a person changed; one without a correction counts as kept."""
    return ratio(F.count_if(corrected.isNotNull() & ~corrected.eqNullSafe(said)), F.count(said))


def final_score(step_rate: Column, task_rate: Column, grounding: Column) -> Column:
    return step_rate * task_rate * grounding


def grounding_score(weights: dict[str, float]) -> Column:
    """Weighted sum of match flags."""
    return sum((F.col(k).cast("int") * w for k, w in weights.items()), F.lit(0.0))
