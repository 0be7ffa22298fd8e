"""What a task's step sees of the steps before it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_history(df: DataFrame, task: str, order: str, plan: str) -> DataFrame:
    """``df`` with ``history``: "None", then the plans of earlier steps in order.

    Rows whose plan is null (failed generation) add nothing.
    """
    before = Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("history", F.concat(F.array(F.lit("None")), F.collect_list(plan).over(before)))


def recorded_index(df: DataFrame, task: str, order: str) -> DataFrame:
    return df.withColumn("step_index", F.row_number().over(Window.partitionBy(task).orderBy(order)) - 1)


def live_rollout(df: DataFrame, task: str, order: str, instruction: str, generate: Callable[[str, list[str]], str]) -> DataFrame:
    """Plans of a live model, where step i needs the answers before it.

    One group is one task, so steps run in order and tasks in parallel; ``generate``
    gets the instruction and the plans so far.  An exception gives a null plan with
    its error, and the next steps go on without it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        history, plans, errors = ["None"], [], []
        pdf = pdf.sort_values(order)
        for text in pdf["__instruction"]:
            try:
                plan, error = generate(text, list(history)), None
                history.append(plan)
            except Exception as e:  # noqa: BLE001 - the model is foreign code
                plan, error = None, str(e)
            plans.append(plan)
            errors.append(error)
        return pdf[[task, order]].assign(plan=plans, error=errors)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (task, order))
    return df.select(task, order, F.col(instruction).alias("__instruction")).groupBy(task).applyInPandas(run, f"{kinds}, plan string, error string")
