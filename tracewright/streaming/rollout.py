"""Plans of a live model over a stream of steps, with each task's history as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Plan = Callable[[str, list[str]], str]


def rollout_stream(steps: DataFrame, task: str, order: str, instruction: str, generate: Plan, last: int | None = None, idle: str | None = None) -> DataFrame:
    """task, order, plan and error of a streaming step table, in append mode.

    Step i of a task sees the plans of all earlier batches and of the earlier steps of
    its own batch, in order; so a stream in which no task's steps arrive before earlier
    ones gives what ``history.live_rollout`` gives on the whole table.  A step at or
    before the last one that was answered (a repeat, or late) gives a null plan with
    an error and doesn't touch the history.  Steps without an order are answered with
    an error too.  An exception of the model gives a null plan with its error.

    State is the plans so far and the last order, kept in Spark's state store, so a
    restart from the checkpoint goes on where the run stopped.  ``last`` bounds the
    history kept of each task; ``idle`` (such as "1 hour") forgets tasks without
    steps for that long.  Null task ids are one task.
    """
    wait = _millis(steps, idle) if idle else 0

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history, seen = (list(state.get[0]), state.get[1]) if state.exists else (["None"], None)
        rows = pd.concat(list(parts), ignore_index=True).sort_values("__order", kind="stable", na_position="last")
        plans, errors = [], []
        for text, at in zip(rows["__instruction"], rows["__order"], strict=True):
            plan, error = None, None
            if pd.isna(at):
                error = "no order"
            elif seen is not None and at <= seen:
                error = "out of order"
            else:
                seen = int(at)
                try:
                    plan = generate(text, list(history))
                    history.append(plan)
                except Exception as e:  # noqa: BLE001 - the model is foreign code
                    error = str(e)
            plans.append(plan)
            errors.append(error)
        if last is not None:
            history = ["None", *history[1:][-last:]] if last else ["None"]
        state.update((history, seen))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({task: [key[0]] * len(rows), order: rows["__order"].astype("Int64"), "plan": plans, "error": errors}, columns=[task, order, "plan", "error"])

    kind = steps.schema[task].dataType.simpleString()
    rows = steps.select(task, F.col(order).cast("long").alias("__order"), F.col(instruction).alias("__instruction"))
    return rows.groupBy(task).applyInPandasWithState(
        run, f"`{task}` {kind}, `{order}` long, plan string, error string", "history array<string>, seen long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )


def _millis(df: DataFrame, span: str) -> int:
    """A time span's text in milliseconds, as Spark reads it."""
    return df.sparkSession.sql("SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + CAST(:span AS INTERVAL)) AS BIGINT)", {"span": span}).first()[0]
