"""Writing results; rates are rounded here and nowhere else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import action_accuracy, by_action_type


def _write(df: DataFrame, path: str, **run: str) -> None:
    """JSON lines by run; writing the same run again replaces its rows and no others."""
    for name, value in run.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run).json(path)


def write_steps(steps: DataFrame, path: str, run_id: str) -> None:
    """Step records as JSON lines, without the chosen element's payload."""
    _write(steps.drop("selected"), f"{path}/step_results", run_id=run_id)


def write_tasks(tasks: DataFrame, nested: DataFrame, path: str, run_id: str, task: str = "annotation_id") -> None:
    """Task records with rates to four places and their steps nested."""
    rounded = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in tasks.dtypes]
    _write(tasks.select(*rounded).join(nested, task), f"{path}/task_results", run_id=run_id)


def write_aggregate(corpus: DataFrame, path: str, run_id: str) -> None:
    _write(corpus, f"{path}/aggregate_metrics", run_id=run_id)


def write_costs(totals: DataFrame, path: str, run_id: str) -> None:
    """Cost totals with dollars to six places."""
    _write(totals.withColumn("cost_usd", F.round("cost_usd", 6)), f"{path}/costs", run_id=run_id)


def accumulate(results: DataFrame, path: str, run_id: str, batch: str) -> None:
    """Adds a batch of evaluated rows to a run; the same batch again replaces itself.

    A new ``run_id`` starts from nothing.
    """
    _write(results, path, run_id=run_id, batch=batch)


def accumulated(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows that a run has gathered so far; the filter prunes folders."""
    return spark.read.json(path).where(F.col("run_id").cast("string") == run_id).drop("run_id", "batch")


def append_checkpoint(ids: DataFrame, path: str, key: str = "annotation_id") -> None:
    """Finished tasks; the commit protocol makes each append all or nothing."""
    ids.select(F.col(key).cast("string").alias("annotation_id")).where(F.coalesce("annotation_id", F.lit("")) != "").write.mode("append").parquet(path)


def write_ledger(calls: DataFrame, path: str, run_id: str, batch: str, keys: tuple[str, ...] = ("annotation_id", "step_index")) -> None:
    """What calls cost, as Parquet; the same batch of a run again replaces itself."""
    named = calls.select("call_id", *keys, "model", "prompt_tokens", "completion_tokens", "latency", "error").withColumns({"run_id": F.lit(run_id), "batch": F.lit(batch)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch").parquet(path)


def ledger(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The calls of a run, each once: an answered one before a failed one, then that of the first batch.

    So a batch cut differently on a rerun bills no call twice.  What a failed call cost
    no longer counts once a later batch got its answer.
    """
    rows = spark.read.parquet(path).where(F.col("run_id").cast("string") == run_id).drop("run_id")
    rest = [c for c in rows.columns if c not in ("call_id", "batch")]
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), F.col("batch").cast("string").alias("batch"), F.struct(*rest).alias("row"))).alias("best")
    return rows.groupBy("call_id").agg(best).select("call_id", "best.row.*")


def report(total: dict, by_type: list[dict], seconds: float | None = None) -> str:
    """A text report of one run's (few) aggregate rows: counts, rates and, if known, the time taken."""
    share = lambda x: f"{x:.2%}"
    n = total["total"]
    lines = [f"Samples: {n}"]
    if seconds is not None:
        lines.append(f"Time: {seconds:.1f} s ({seconds / n if n else 0.0:.2f} s a sample)")
    for k in ("action_accuracy", "target_accuracy", "value_accuracy"):
        lines.append(f"{k.replace('_', ' ').capitalize()}: {share(total[k])} ({round(total[k] * n)} of {n})")
    lines.append("")
    for row in by_type:
        lines += [f"{row['oracle_action_type']} (n={row['total']})", *(f"  {k.removesuffix('_match_rate')}: {share(v)}" for k, v in row.items() if k.endswith("_match_rate"))]
    return "\n".join(lines)


def show_summary(pairs: DataFrame, seconds: float | None = None, say: Callable[[str], None] = print) -> str:
    """Says (prints, by default) the report of evaluated pairs and returns it; only aggregate rows reach the driver."""
    text = report(action_accuracy(pairs).first().asDict(), [r.asDict() for r in by_action_type(pairs).orderBy("oracle_action_type").collect()], seconds)
    say(text)
    return text


def write_run(detailed: DataFrame, metrics: DataFrame, failed: DataFrame, path: str, run_id: str, text: str | None = None) -> None:
    """A run's folder: details, summary and failures, each a distributed write, and the text report if given."""
    for name, df in (("detailed_results", detailed), ("metrics_summary", metrics), ("failure_cases", failed)):
        df.write.mode("overwrite").json(f"{path}/run_{run_id}/{name}")
    if text is not None:
        detailed.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run_{run_id}/report")
