"""Predictions against ground truth: two evaluators, deliberately apart.

``action_flags`` compares actions (selector, box or point; exact values);
``step_flags`` compares a plan and a chosen element with a recorded step (node
ids; loose values).  Their synonyms differ as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import boxes_match, points_match
from ..functions.jsonfn import truth_ids, truth_operation, truth_value
from ..functions.text import element_label, or_null, plan_action, plan_value, strip


def _is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def actions_match(a: Column, b: Column) -> Column:
    """Equal, or click and select, or click and hover; select and hover are not synonyms."""
    a, b = F.lower(strip(a)), F.lower(strip(b))
    pair = lambda other: a.isin("click", other) & b.isin("click", other)
    return _is_true((a == b) | pair("select") | pair("hover"))


def selectors_match(a: Column, b: Column) -> Column:
    """Equal but for case and outer white space; two missing ones match."""
    return F.lower(strip(a)).eqNullSafe(F.lower(strip(b)))


def targets_match(a: Column, b: Column, limit: float = 24.0) -> Column:
    """The first kind of target that both have decides: selector, box, point."""
    both = lambda k: _is_true((a[k] != "") & (b[k] != "")) if k == "selector" else _is_true((F.size(a[k]) > 0) & (F.size(b[k]) > 0))
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(both("selector"), selectors_match(a["selector"], b["selector"]))
        .when(both("bbox"), boxes_match(a["bbox"], b["bbox"], limit))
        .when(both("coords"), points_match(a["coords"], b["coords"], limit))
        .otherwise(False)
    )


def action_flags(df: DataFrame, predicted: str = "predicted", oracle: str = "oracle", limit: float = 24.0) -> DataFrame:
    """``df`` with action_match, target_match, value_match and overall_match.

    Values count only where the oracle types, exactly and with case.
    """
    p, o = F.col(predicted), F.col(oracle)
    flags = {
        "action_match": actions_match(p["action_type"], o["action_type"]),
        "target_match": targets_match(p["target"], o["target"], limit),
        "value_match": F.when(_is_true(o["action_type"] == "type"), p["value"].eqNullSafe(o["value"])).otherwise(True),
    }
    return df.withColumns(flags).withColumn("overall_match", F.col("action_match") & F.col("target_match") & F.col("value_match"))


def operation_class(op: Column) -> Column:
    """One name for CLICK, SELECT and HOVER, and one for INPUT and TYPE."""
    op = F.upper(strip(F.coalesce(op, F.lit(""))))
    return F.when(op.isin("CLICK", "SELECT", "HOVER"), "CLICK").when(op.isin("INPUT", "TYPE"), "TYPE").otherwise(op)


def operations_match(a: Column, b: Column) -> Column:
    return operation_class(a) == operation_class(b)


def element_found(chosen: Column, truth: Column) -> Column:
    """A chosen id among the true ones; nothing chosen or nothing true never matches."""
    return _is_true((chosen != "") & F.array_contains(truth, chosen))


def typed_value_matches(operation: Column, predicted: Column, truth: Column) -> Column:
    """Only typing steps with a true value can fail; case and outer blanks don't count."""
    loose = lambda x: F.lower(strip(F.coalesce(x, F.lit(""))))
    free = ~operation_class(operation).isin("TYPE") | (loose(truth) == "")
    return free | (loose(predicted) == loose(truth))


def chosen_id(element: Column) -> Column:
    """Node id of a chosen element: the outer one, else its attribute's, else ''."""
    return F.coalesce(or_null(element["backend_node_id"].cast("string")), or_null(element["attributes"]["backend_node_id"]), F.lit(""))


def step_flags(df: DataFrame) -> DataFrame:
    """``df`` (true_operation, true_value, true_ids, predicted_operation,
    predicted_value, predicted_id) with the three matches and step_success."""
    c = F.col
    return df.withColumns({
        "operation_match": operations_match(c("predicted_operation"), c("true_operation")),
        "element_match": element_found(c("predicted_id"), c("true_ids")),
        "value_match": typed_value_matches(c("true_operation"), c("predicted_value"), c("true_value")),
    }).withColumn("step_success", c("operation_match") & c("element_match") & c("value_match"))


def step_records(steps: DataFrame, outputs: DataFrame) -> DataFrame:
    """The fact table: steps joined with model outputs (annotation_id, step_index,
    plan, selected struct<backend_node_id,attributes>, latency, error).

    A step whose generation failed leaves the denominator; an empty plan stays as
    a failed step.  step_index counts the recorded steps of a task from 0.
    """
    from pyspark.sql import Window

    joined = steps.join(outputs.where("error is null"), ["annotation_id", "step_index"])
    extracted = joined.select(
        "annotation_id",
        F.col("step_index").alias("recorded_at"),
        F.col("confirmed_task").alias("instruction"),
        "website",
        "domain",
        truth_operation(F.col("operation")).alias("true_operation"),
        truth_value(F.col("operation")).alias("true_value"),
        truth_ids(F.col("pos_candidates")).alias("true_ids"),
        element_label(F.col("target_action_reprs"), F.col("action_reprs")).alias("true_element"),
        "plan",
        plan_action(F.col("plan")).alias("predicted_operation"),
        chosen_id(F.col("selected")).alias("predicted_id"),
        "latency",
    ).withColumn("predicted_value", F.when(F.col("predicted_operation").isin("TYPE", "INPUT"), plan_value(F.col("plan"))).otherwise(""))
    order = Window.partitionBy("annotation_id").orderBy("recorded_at")
    return step_flags(extracted).withColumn("step_index", F.row_number().over(order) - 1).drop("recorded_at")
