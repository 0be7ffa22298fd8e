"""Agent-trace tables derived from the generic driver tables by plain expressions.

The same expressions are easy to write in any SQL dialect, so each query can be
checked against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def action_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predicted and oracle actions.

    The oracle's type follows the event; every seventh prediction has another type,
    every fifth another place, every third typed value another case.
    """
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "type").when(F.col("event_type") == "view", "scroll").when(F.col("event_type") == "purchase", "select").otherwise("noop")
    other = F.when(i % 7 == 0, F.when(i % 2 == 0, "hover").otherwise("click")).otherwise(kind)
    none = F.lit(None)
    box = lambda dx: F.array(*(x.cast("double") for x in ((i % 500) + dx, (i % 300) + dx, F.lit(40), F.lit(20))))
    point = lambda dx: F.array(((i % 640) + dx).cast("double"), (i % 480).cast("double"))
    shift = F.when(i % 5 == 0, 30).otherwise(3)

    def target(moved):
        selector = F.when(i % 3 == 0, F.concat(F.lit("#b"), (i % 11).cast("string"), F.when(moved != 0, F.when(i % 5 == 0, "x").otherwise(" ")).otherwise("")))
        return F.when(i % 13 != 0, F.struct(selector.alias("selector"), F.when(i % 3 == 1, box(moved)).alias("bbox"), F.when(i % 3 == 2, point(moved)).alias("coords"), none.cast("string").alias("text")))

    value = F.when(kind == "type", F.concat(F.lit("Text "), (i % 9).cast("string")))
    said = F.when(i % 3 == 0, F.lower(value)).otherwise(value)
    return e.select(
        "event_id",
        kind.alias("oracle_action_type"),
        F.struct(kind.alias("action_type"), target(F.lit(0)).alias("target"), value.alias("value")).alias("oracle"),
        F.struct(other.alias("action_type"), target(shift).alias("target"), said.alias("value")).alias("predicted"),
    )


#: The same flags in SQL, from the same rules.
ACTION_PAIRS_SQL = """
e AS (SELECT event_id AS i, CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'type' WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'select' ELSE 'noop' END AS o FROM events),
p AS (SELECT i, o, CASE WHEN i % 7 = 0 THEN CASE WHEN i % 2 = 0 THEN 'hover' ELSE 'click' END ELSE o END AS a, CASE WHEN i % 5 = 0 THEN 30 ELSE 3 END AS s FROM e),
flags AS (SELECT i AS event_id, o AS oracle_action_type,
  (a = o OR (a IN ('click', 'select') AND o IN ('click', 'select')) OR (a IN ('click', 'hover') AND o IN ('click', 'hover'))) AS action_match,
  CASE WHEN i % 13 = 0 THEN true WHEN i % 3 = 0 THEN i % 5 <> 0 WHEN i % 3 = 1 THEN sqrt(2.0 * s * s) <= 24 ELSE s <= 24 END AS target_match,
  CASE WHEN o = 'type' THEN i % 3 <> 0 ELSE true END AS value_match FROM p),
f AS (SELECT *, action_match AND target_match AND value_match AS overall_match FROM flags)
"""


def recorded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tasks: each turn is a step with truth and prediction."""
    c, n = table(spark, sf_dir, "conversations"), F.col("n")
    rows = c.select(F.col("conv_id").alias("annotation_id"), F.col("turn").alias("step_index"), "role", F.length("text").alias("n"))
    true_op = F.element_at(F.array(*map(F.lit, ("CLICK", "TYPE", "SELECT", "HOVER", "SCROLL"))), (n % 5 + 1).cast("int"))
    said_op = F.when(n % 11 == 0, "scroll").when(true_op == "TYPE", "input").when(true_op == "SELECT", "click").otherwise(F.lower(true_op))
    return rows.select(
        "annotation_id", "step_index", F.col("role").alias("instruction"), "n",
        true_op.alias("true_operation"),
        F.when(true_op == "TYPE", F.when(n % 2 == 0, F.concat(F.lit("V"), n.cast("string"))).otherwise("")).otherwise("").alias("true_value"),
        F.when(n % 17 == 0, F.array().cast("array<string>")).otherwise(F.array((n % 10).cast("string"), (n % 10 + 10).cast("string"))).alias("true_ids"),
        F.upper(said_op).alias("predicted_operation"),
        F.when(n % 4 == 0, F.concat(F.lit(" v"), n.cast("string"), F.lit(" "))).otherwise("other").alias("predicted_value"),
        F.when(n % 19 == 0, "").when(n % 6 == 0, "99").otherwise((n % 10).cast("string")).alias("predicted_id"),
    )


STEPS_SQL = """
c AS (SELECT conv_id AS annotation_id, turn AS step_index, role AS instruction, length(text) AS n FROM conversations),
o AS (SELECT *, (['CLICK', 'TYPE', 'SELECT', 'HOVER', 'SCROLL'])[n % 5 + 1] AS t FROM c),
q AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'SCROLL' WHEN t = 'TYPE' THEN 'INPUT' WHEN t = 'SELECT' THEN 'CLICK' ELSE t END AS p FROM o),
m AS (SELECT annotation_id, step_index, instruction,
  (p = t OR (p IN ('CLICK', 'SELECT', 'HOVER') AND t IN ('CLICK', 'SELECT', 'HOVER')) OR (p IN ('INPUT', 'TYPE') AND t IN ('INPUT', 'TYPE'))) AS operation_match,
  (n % 19 <> 0 AND n % 6 <> 0 AND n % 17 <> 0) AS element_match,
  (t <> 'TYPE' OR n % 2 <> 0 OR n % 4 = 0) AS value_match FROM q),
s AS (SELECT *, operation_match AND element_match AND value_match AS step_success FROM m)
"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plan texts in the shapes that models produce."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("click", "input", "type", "select", "scroll", "hover"))), (i % 6 + 1).cast("int"))
    text = (
        F.when(i % 8 == 0, F.concat(F.lit("ACTION_TYPE: "), kind))
        .when(i % 8 == 1, F.concat(F.lit("Then Action_Type = "), F.upper(kind), F.lit(" now")))
        .when(i % 8 == 2, F.concat(F.lit("Action  Type: "), kind))
        .when(i % 8 == 3, F.concat(kind, F.lit(': Enter "Item '), (i % 23).cast("string"), F.lit('"')))
        .when(i % 8 == 4, F.lit("  finish "))
        .when(i % 8 == 5, F.concat(F.lit("I would "), kind))
        .when(i % 8 == 6, F.concat(kind, F.lit(": word "), (i % 31).cast("string"), F.lit(" ")))
        .otherwise("")
    )
    return e.select("event_id", text.alias("plan"))


PLANS_SQL = """
k AS (SELECT event_id AS i, (['click', 'input', 'type', 'select', 'scroll', 'hover'])[event_id % 6 + 1] AS kind FROM events),
t AS (SELECT i AS event_id, CASE i % 8 WHEN 0 THEN 'ACTION_TYPE: ' || kind WHEN 1 THEN 'Then Action_Type = ' || upper(kind) || ' now' WHEN 2 THEN 'Action  Type: ' || kind
  WHEN 3 THEN kind || ': Enter "Item ' || (i % 23) || '"' WHEN 4 THEN '  finish ' WHEN 5 THEN 'I would ' || kind WHEN 6 THEN kind || ': word ' || (i % 31) || ' ' ELSE '' END AS plan FROM k)
"""


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw model outputs, sound and broken in eight ways."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    n, s = (i % 7).cast("string"), F.lit
    text = (
        F.when(i % 8 == 0, F.concat(s('{"action_type":"click","target":{"selector":"#a'), n, s('"},"value":null,"confidence":0.9}')))
        .when(i % 8 == 1, F.concat(s('```json\n{"action_type":"type","target":{"coords":[0.5,0.25]},"value":"v'), n, s('","confidence":0.75}\n```')))
        .when(i % 8 == 2, s('{"action_type":"scroll","target":null,}'))
        .when(i % 8 == 3, s('Next I would {"action_type":"scroll","target":null,"confidence":0.5}, thanks'))
        .when(i % 8 == 4, F.concat(s("{'action_type': 'click', 'target': {'selector': '#q"), n, s("'}, 'confidence': 0.25}")))
        .when(i % 8 == 5, s('"action": "noop", "confidence": 0.125'))
        .when(i % 8 == 6, s("nothing here says what to press"))
        .otherwise("")
    )
    return e.select("event_id", text.alias("raw"))
