"""The engine's queries over the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, geometry, images, jsonfn, text
from ..functions.html import dom_summary, interactive_elements
from ..models import Answer, billed_calls, generate_batches, generate_plans, score_pairs
from ..operators import checkpoint, decode, history, match, metrics, ranking, sampling, state, uncertainty, vectors
from ..sources.steps import candidates, union_all, with_default, with_page
from . import derive
from .derive import ACTION_PAIRS_SQL, PLANS_SQL, STEPS_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Rows and samples


@query("SELECT conv_id, turn, role, text AS instruction FROM conversations WHERE conv_id = 3")
def task_lookup(spark, sf):
    rows = sampling.task(table(spark, sf, "conversations"), "conv_id", 3)
    return rows.select("conv_id", "turn", "role", F.col("text").alias("instruction"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def task_of_row(spark, sf):
    return sampling.task_of_row(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7, "o_custkey")


@query("SELECT conv_id, min(turn) AS first_seen FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def distinct_tasks(spark, sf):
    return sampling.distinct_tasks(table(spark, sf, "conversations"), "conv_id", "turn")


@query("SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 200")
def hash_sample_n(spark, sf):
    return sampling.sample_n(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 200)


@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|7'), event_id LIMIT (SELECT CAST(floor(count(*) * 0.05 + 0.5) AS BIGINT) FROM events)")
def hash_sample_fraction(spark, sf):
    return sampling.sample_fraction(table(spark, sf, "events").select("event_id"), "event_id", 0.05, 7)


@query("SELECT event_id, event_type, NULL AS value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, value FROM events WHERE event_type <> 'click'")
def multi_scan_union(spark, sf):
    e = table(spark, sf, "events")
    return union_all([e.where("event_type = 'click'").select("event_id", "event_type"), e.where("event_type <> 'click'").select("event_id", "value")])


# Ground truth and text


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'type' ELSE 'error' END AS action_type, CASE WHEN event_id % 4 = 0 THEN '#e' || event_id END AS selector, CASE WHEN event_id % 3 > 0 THEN 'v' || (event_id % 3) END AS value FROM events")
def oracle_action(spark, sf):
    i = F.col("event_id")
    op = F.when(F.col("event_type") == "purchase", "SELECT").when(F.col("event_type") == "view", "scroll").when(F.col("event_type") == "signup", "Type").otherwise(F.col("event_type"))
    raw = F.to_json(F.struct(op.alias("op"), F.when(i % 4 == 0, F.concat(F.lit("#e"), i.cast("string"))).alias("selector"), F.when(i % 3 > 0, F.concat(F.lit("v"), (i % 3).cast("string"))).otherwise("").alias("value")))
    action = jsonfn.oracle_action(F.col("operation"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("operation"))
    return rows.select("event_id", action["action_type"].alias("action_type"), action["target"]["selector"].alias("selector"), action["value"].alias("value"))


@query("SELECT event_id, upper(event_type) AS operation, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_field_extract(spark, sf):
    operation = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit(" "), "event_type").alias("op")))).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", jsonfn.truth_operation(operation).alias("operation"), jsonfn.field(F.col("props"), "k").alias("k"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' WHEN 3 THEN 'scroll' WHEN 4 THEN 'click' WHEN 5 THEN 'noop' END AS action_type,
  CASE event_id % 8 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 WHEN 4 THEN 0.25 WHEN 5 THEN 0.125 END::DOUBLE AS confidence,
  CASE WHEN event_id % 8 = 1 THEN 'v' || (event_id % 7) END AS value, event_id % 8 < 6 AS readable FROM events""")
def json_repair_cascade(spark, sf):
    rows = jsonfn.repair_json(derive.model_outputs(spark, sf), "raw", "p")
    g = lambda k: F.get_json_object("p.json", f"$.{k}")
    return rows.select("event_id", g("action_type").alias("action_type"), g("confidence").try_cast("double").alias("confidence"), g("value").alias("value"), F.col("p.json").isNotNull().alias("readable"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' WHEN 3 THEN 'scroll' WHEN 4 THEN 'click' ELSE 'noop' END AS action_type,
  CASE event_id % 8 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5 WHEN 4 THEN 0.25 WHEN 5 THEN 0.125 ELSE 0.0 END::DOUBLE AS confidence,
  CASE event_id % 8 WHEN 0 THEN '#a' || (event_id % 7) WHEN 4 THEN '#q' || (event_id % 7) END AS selector,
  CASE WHEN event_id % 8 = 1 THEN 640.0 END::DOUBLE AS x, CASE WHEN event_id % 8 = 1 THEN 180.0 END::DOUBLE AS y, event_id % 8 >= 6 AS failed FROM events""")
def decode_actions(spark, sf):
    out = decode.decode_actions(derive.model_outputs(spark, sf), "raw", F.lit(1280.0), F.lit(720.0))
    a = F.col("action")
    return out.select("event_id", a["action_type"].alias("action_type"), a["confidence"].alias("confidence"), a["target"]["selector"].alias("selector"), F.get(a["target"]["coords"], F.lit(0)).alias("x"), F.get(a["target"]["coords"], F.lit(1)).alias("y"), F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {PLANS_SQL} SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2, 3, 6) THEN upper((['click', 'input', 'type', 'select', 'scroll', 'hover'])[event_id % 6 + 1]) WHEN event_id % 8 = 4 THEN 'FINISH' ELSE '' END AS action FROM t""")
def plan_action_type(spark, sf):
    return derive.plans(spark, sf).select("event_id", text.plan_action(F.col("plan")).alias("action"))


@query(rf"""WITH {PLANS_SQL} SELECT event_id, trim(CASE WHEN regexp_extract(plan, '(?i)(?:input|type)\s*[:\-]\s*.*?"([^"]+)"', 1) <> '' THEN regexp_extract(plan, '(?i)(?:input|type)\s*[:\-]\s*.*?"([^"]+)"', 1)
  ELSE regexp_extract(plan, '(?i)(?:input|type)\s*:\s*(.+)', 1) END) AS value FROM t""")
def plan_typed_value(spark, sf):
    return derive.plans(spark, sf).select("event_id", text.plan_value(F.col("plan")).alias("value"))


_SQUEEZE = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_SQUEEZE}) > 120 THEN substr({_SQUEEZE}, 1, 120) || '...' ELSE {_SQUEEZE} END AS short FROM documents")
def whitespace_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.shorten(text.squeeze(F.col("text")), 120).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE text[1:1200] || chr(10) || '...' || chr(10) || right(text, 800) END AS trimmed FROM documents")
def head_tail_trim(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.head_tail(F.col("text")).alias("trimmed"))


# Matching


@query("""WITH k AS (SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS ids, min(l_partkey) AS low FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(list_contains(ids, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN CAST(low AS VARCHAR) ELSE '1' END), false) AS found FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""")
def gt_membership(spark, sf):
    ids = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.to_json(F.struct(F.col("l_partkey").alias("backend_node_id")))).alias("candidates"), F.min("l_partkey").alias("low"))
    rows = table(spark, sf, "orders").select("o_orderkey").join(ids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    chosen = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.col("low").cast("string")).otherwise("1")
    return rows.select("o_orderkey", match.element_found(chosen, jsonfn.truth_ids(F.col("candidates"))).alias("found"))


@query("SELECT l_orderkey, l_linenumber, sqrt(power((l_quantity + 10) - (2 * l_quantity + 5), 2) + power(l_linenumber * 1.5 - l_linenumber, 2)) <= 24 AS near FROM lineitem")
def bbox_centroid_match(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    zero = F.lit(0.0)
    a, b = F.array(q, n, F.lit(20.0), n), F.array(2 * q, n, F.lit(10.0), zero)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geometry.boxes_match(a, b).alias("near"))


@query("SELECT event_id, CASE WHEN value BETWEEN 0 AND 1 THEN value * 1920 ELSE value END AS x, CASE WHEN value BETWEEN 0 AND 1 THEN 540.0::DOUBLE ELSE 0.5::DOUBLE END AS y FROM events")
def coord_normalise(spark, sf):
    at = geometry.scaled(F.array(F.col("value"), F.lit(0.5)), F.lit(1920.0), F.lit(1080.0), 2)
    return table(spark, sf, "events").select("event_id", at[0].alias("x"), at[1].alias("y"))


@query("""WITH s AS (SELECT event_id, 300 + event_id % 1700 AS w, 200 + event_id % 900 AS h FROM events), f AS (SELECT *, least(1280.0::DOUBLE / w, 720.0::DOUBLE / h) AS scale FROM s)
SELECT event_id, CAST(floor(w * scale) AS BIGINT) AS width, CAST(floor(h * scale) AS BIGINT) AS height, (640.0 - floor((1280 - floor(w * scale)) / 2)) / scale AS x FROM f""")
def fit_resize(spark, sf):
    w, h = 300 + F.col("event_id") % 1700, 200 + F.col("event_id") % 900
    rows = table(spark, sf, "events").select("event_id", geometry.fit(w, h, 1280, 720).alias("f"))
    return rows.select("event_id", "f.width", "f.height", geometry.to_original(F.array(F.lit(640.0), F.lit(360.0)), F.col("f"))[0].alias("x"))


@query(f"WITH {ACTION_PAIRS_SQL} SELECT event_id, target_match FROM f")
def target_cascade(spark, sf):
    rows = derive.action_pairs(spark, sf)
    return rows.select("event_id", match.targets_match(F.col("predicted.target"), F.col("oracle.target")).alias("target_match"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'Invalid action_type: ' || event_type
  WHEN (CASE event_type WHEN 'view' THEN event_id % 4 = 1 WHEN 'signup' THEN event_id % 4 < 2 ELSE event_id % 4 < 2 END) THEN 'Invalid target for action_type=' || CASE event_type WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'type' ELSE 'click' END
  WHEN event_id % 10 = 0 THEN 'Invalid confidence' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'type action requires non-empty value field' END AS error FROM events""")
def validate_prediction(spark, sf):
    i, e = F.col("event_id"), F.col("event_type")
    kind = F.when(e == "view", "scroll").when(e == "signup", "type").otherwise(e)
    target = F.when(i % 4 == 1, "{}").when(i % 4 > 1, '{"selector": ""}')
    confidence = F.when(i % 10 == 0, F.when(i % 20 == 0, float("nan")).otherwise(1.5)).otherwise(0.5)
    return table(spark, sf, "events").select("event_id", decode.prediction_error(kind, target, confidence, F.when(i % 3 > 0, "x").otherwise("")).alias("error"))


@query(f"WITH {STEPS_SQL} SELECT annotation_id, step_index, operation_match, element_match, value_match, step_success FROM s")
def step_flags(spark, sf):
    return match.step_flags(derive.recorded_steps(spark, sf)).select("annotation_id", "step_index", "operation_match", "element_match", "value_match", "step_success")


# Aggregates

_RATES = "avg(element_match::INT) AS element_accuracy, avg(operation_match::INT) AS operation_accuracy, avg(value_match::INT) AS value_accuracy, avg(step_success::INT) AS step_success_rate"


@query(f"WITH {STEPS_SQL} SELECT annotation_id, count(*) AS total_steps, {_RATES}, count(*) = count_if(step_success) AS offline0, count(*) - count_if(step_success) <= 1 AS offline1, arg_min(instruction, step_index) AS instruction FROM s GROUP BY annotation_id")
def task_metrics(spark, sf):
    return metrics.task_metrics(match.step_flags(derive.recorded_steps(spark, sf)), meta=("instruction",))


@query(f"""WITH {STEPS_SQL}, k AS (SELECT annotation_id, count(*) - count_if(step_success) AS failed FROM s GROUP BY annotation_id)
SELECT count(*) AS total_steps, (SELECT count(*) FROM k) AS total_tasks, {_RATES}, (SELECT avg((failed = 0)::INT) FROM k) AS offline0_rate, (SELECT avg((failed <= 1)::INT) FROM k) AS offline1_rate FROM s""")
def corpus_metrics(spark, sf):
    return metrics.corpus_metrics(match.step_flags(derive.recorded_steps(spark, sf)))


@query(f"""WITH {STEPS_SQL}, k AS (SELECT annotation_id, count(*) AS n, count(*) = count_if(step_success) AS ok FROM s GROUP BY annotation_id)
SELECT CASE WHEN n <= 3 THEN '<=3' WHEN n <= 5 THEN '<=5' WHEN n <= 8 THEN '<=8' ELSE '>8' END AS length, count(*) AS tasks, avg(ok::INT) AS offline0_rate FROM k GROUP BY 1""")
def tasks_by_length(spark, sf):
    return metrics.by_task_length(metrics.task_metrics(match.step_flags(derive.recorded_steps(spark, sf))))


@query(f"WITH {STEPS_SQL} SELECT annotation_id, count(*) AS n, string_agg(step_index || ':' || step_success::INT, ',' ORDER BY step_index) AS steps FROM s GROUP BY annotation_id")
def nested_steps(spark, sf):
    nested = metrics.nested_steps(match.step_flags(derive.recorded_steps(spark, sf)), columns=("step_success",))
    line = lambda s: F.concat(s["step_index"].cast("string"), F.lit(":"), s["step_success"].cast("int").cast("string"))
    return nested.select("annotation_id", F.size("steps").cast("long").alias("n"), F.array_join(F.transform("steps", line), ",").alias("steps"))


_FLAG_COLUMNS = ", ".join(f"count_if({f}) AS {f}_count, avg({f}::INT) AS {f}_rate" for f in metrics.ACTION_FLAGS)


@query(f"WITH {ACTION_PAIRS_SQL} SELECT oracle_action_type, count(*) AS total, {_FLAG_COLUMNS} FROM f GROUP BY oracle_action_type")
def per_action_breakdown(spark, sf):
    return metrics.by_action_type(match.action_flags(derive.action_pairs(spark, sf)))


@query(f"WITH {ACTION_PAIRS_SQL} SELECT count(*) AS total, avg(action_match::INT) AS action_accuracy, avg(target_match::INT) AS target_accuracy, avg(value_match::INT) AS value_accuracy FROM f")
def aa_ta_va(spark, sf):
    return metrics.action_accuracy(match.action_flags(derive.action_pairs(spark, sf)))


@query(f"WITH {ACTION_PAIRS_SQL} SELECT event_id, action_match, target_match, value_match FROM f WHERE NOT overall_match")
def failure_cases(spark, sf):
    failed = metrics.failures(match.action_flags(derive.action_pairs(spark, sf)), "overall_match")
    return failed.select("event_id", "action_match", "target_match", "value_match")


@query(f"WITH {ACTION_PAIRS_SQL} SELECT event_id FROM f WHERE NOT target_match ORDER BY event_id LIMIT 3")
def first_failures(spark, sf):
    return metrics.failures(match.action_flags(derive.action_pairs(spark, sf)), "target_match", 3, ("event_id",)).select("event_id")


@query(f"""WITH {ACTION_PAIRS_SQL}, g AS (SELECT event_id, o.o AS oracle_action_type, CASE WHEN event_id % 6 = 0 THEN o.o = 'noop' ELSE action_match END AS ok FROM f JOIN e o ON o.i = f.event_id)
SELECT count(*) AS total, count_if(ok) AS correct FROM g""")
def missing_prediction_fill(spark, sf):
    pairs = derive.action_pairs(spark, sf)
    filled = metrics.with_noop_fill(pairs.select("event_id", "oracle"), pairs.where("event_id % 6 <> 0").select("event_id", "predicted"), "event_id")
    return match.action_flags(filled).agg(F.count(F.lit(1)).alias("total"), F.count_if("action_match").alias("correct"))


@query("SELECT lang, count(*) AS total, avg((quality = 1)::INT) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def label_accuracy(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), geometry.ratio(F.count_if(F.col("quality") == 1), F.count(F.lit(1))).alias("accuracy"))


@query(f"WITH {ACTION_PAIRS_SQL} SELECT CAST(least(floor((event_id % 100) / 100.0 * 10), 9) AS INT) AS bucket, count(*) AS total, avg(overall_match::INT) AS accuracy FROM f GROUP BY 1")
def accuracy_by_confidence(spark, sf):
    return metrics.by_confidence(match.action_flags(derive.action_pairs(spark, sf)), (F.col("event_id") % 100) / F.lit(100.0), "overall_match")


# History, ranking, bookkeeping


@query("SELECT conv_id, turn, 'None' || coalesce('|' || string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def running_history(spark, sf):
    rows = history.running_history(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")
    return rows.select("conv_id", "turn", F.array_join("history", "|").alias("history"))


@query("""WITH h AS (SELECT conv_id, turn, role, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM conversations)
SELECT conv_id, turn, 'Task: ' || role || chr(10) || 'Done so far:' || chr(10) || '0. None' || coalesce(array_to_string([chr(10) || i || '. ' || x FOR x, i IN l], ''), '') || chr(10)
  || 'Answer with one line, ACTION_TYPE: one of click, input, type, select, scroll, finish, hover, and the target.' AS prompt FROM h""")
def step_prompts(spark, sf):
    rows = history.running_history(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")
    return rows.select("conv_id", "turn", text.step_prompt(F.col("role"), F.col("history")).alias("prompt"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_index FROM conversations WHERE role <> 'system'")
def step_index(spark, sf):
    rows = table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn")
    return history.recorded_index(rows, "conv_id", "turn").withColumn("step_index", F.col("step_index").cast("long"))


@query("SELECT l_orderkey, l_linenumber, rn - 1 AS rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def topk_candidates(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top_candidates(rows, "l_orderkey", 3, "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT event_id, event_id % 6 AS n, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 9 AS VARCHAR) WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN '-' || (event_id % 4) WHEN 3 THEN 'element ' || (event_id % 3) || ' or 7' ELSE '' END AS ans FROM events),
i AS (SELECT *, TRY_CAST(regexp_extract(ans, '\\b(\\d+)\\b', 1) AS INT) AS k FROM a)
SELECT event_id, CASE WHEN n = 0 THEN NULL WHEN k < n THEN k ELSE (SELECT 0) END AS chosen FROM i""".replace("\\\\", "\\"))
def answer_choice(spark, sf):
    i = F.col("event_id")
    answer = F.when(i % 5 == 0, (i % 9).cast("string")).when(i % 5 == 1, "NO_MATCH").when(i % 5 == 2, F.concat(F.lit("-"), (i % 4).cast("string"))).when(i % 5 == 3, F.concat(F.lit("element "), (i % 3).cast("string"), F.lit(" or 7"))).otherwise("")
    # Tied scores: the first wins.
    candidates = F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), 1, (i % 6).cast("int")), lambda k: F.struct(F.lit(0.5).alias("score"), F.struct(k.alias("index"), F.lit("").alias("representation")).alias("element")))
    return table(spark, sf, "events").select("event_id", ranking.choose_element(answer, candidates)["element"]["index"].alias("chosen"))


@query("""WITH w AS (SELECT doc_id, lower(substr(text, 1, length(text) // 2)) AS a, lower(substr(text, length(text) // 2 + 1)) AS b FROM documents)
SELECT doc_id, CAST((CASE WHEN contains(a, b) OR contains(b, a) THEN 100 ELSE 0 END) + len(list_intersect(list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')))) AS INT) AS score FROM w""".replace("\\\\", "\\"))
def text_overlap(spark, sf):
    # Both halves of each text, so that every character is read.
    t = F.col("text")
    half = F.floor(F.length(t) / 2).cast("int")
    return table(spark, sf, "documents").select("doc_id", ranking.overlap_score(t.substr(F.lit(1), half), t.substr(half + 1, F.length(t))).cast("int").alias("score"))


NEAREST_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]) AS c FROM q JOIN embeddings ON vec_id <> query_id)
SELECT query_id, vec_id, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rn FROM s) WHERE rn <= 5"""


@query(NEAREST_SQL)
def cosine_rank(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ranking.nearest_vectors(e, e.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(NEAREST_SQL)
def cosine_clusters(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.nearest_in_clusters(e, e.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, false AS skipped FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 4 = 0")
def checkpoint_skip(spark, sf):
    tasks = table(spark, sf, "orders").select("o_orderkey")
    done = tasks.where("o_orderkey % 4 = 0")
    run = checkpoint.pending(tasks, done, "o_orderkey").withColumn("skipped", F.lit(False))
    return run.unionByName(checkpoint.skipped(tasks, done, "o_orderkey").select("o_orderkey", "skipped"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_pending(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return checkpoint.pending_by_bitmap(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def documents_pending(spark, sf):
    done = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return checkpoint.pending_by_bitmap(table(spark, sf, "documents").select("doc_id", "lang"), done, "doc_id")


@query("SELECT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'")
def checkpoint_add(spark, sf):
    ids = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return checkpoint.add(ids("F"), ids("O"), "id")


@query("""WITH m AS (SELECT *, (['gpt-4o', 'gpt-4o-mini', 'gpt-4o-mini-2024-07-18', 'provider/gpt-4o-x', 'other', 'GPT-4o-2024'])[event_id % 6 + 1] AS model, 100 + event_id % 900 AS t, event_id % 128 AS u FROM events),
k AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'gpt-4o' WHEN 3 THEN 'gpt-4o' WHEN 5 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS price_key FROM m)
SELECT price_key, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens_in, CAST(sum(u) AS BIGINT) AS tokens_out, (sum(t) * CASE price_key WHEN 'gpt-4o' THEN 2.50::DOUBLE ELSE 0.15::DOUBLE END + sum(u) * CASE price_key WHEN 'gpt-4o' THEN 10.00::DOUBLE ELSE 0.60::DOUBLE END) / 1e6 AS usd FROM k GROUP BY price_key""")
def cost_ledger(spark, sf):
    i = F.col("event_id")
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o", "gpt-4o-mini", "gpt-4o-mini-2024-07-18", "provider/gpt-4o-x", "other", "GPT-4o-2024"))), (i % 6 + 1).cast("int"))
    calls = table(spark, sf, "events").select(cost.price_key(model).alias("price_key"), (100 + i % 900).alias("t"), (i % 128).alias("u"))
    used = calls.groupBy("price_key").agg(F.count(F.lit(1)).alias("calls"), F.sum("t").alias("tokens_in"), F.sum("u").alias("tokens_out"))
    return used.withColumn("usd", cost.call_cost(F.col("price_key"), F.col("tokens_in"), F.col("tokens_out")))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total_latency, round(avg(value), 4) AS mean_latency FROM events GROUP BY event_type")
def latency_summary(spark, sf):
    out = metrics.latency(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "calls", F.round("total_latency", 4).alias("total_latency"), F.round("mean_latency", 4).alias("mean_latency"))


# Pages and models


@query("SELECT page_id, CAST((length(html) - length(replace(html, '<a href=', ''))) / length('<a href=') AS BIGINT) AS n FROM pages")
def interactive_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(interactive_elements("html")).cast("long").alias("n"))


@query(None)
def interactive_elements_of_pages(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(interactive_elements("html")).alias("e"))
    return rows.select("page_id", "e.index", "e.tag", "e.text", "e.representation", text.candidate_line(F.col("e.index"), F.col("e"), F.lit(0.0)).alias("line"))


@query(None)
def page_summary(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(dom_summary("html")).alias("e"))
    return rows.select("page_id", "e.tag", "e.text", "e.id", "e.class")


STUB_SQL = """SELECT doc_id, 'ACTION_TYPE: ' || CASE k WHEN 0 THEN 'click' WHEN 1 THEN 'type "' || substr(t, 1, 12) || '"' WHEN 2 THEN 'scroll' ELSE 'finish' END AS output_text, CAST(NULL AS VARCHAR) AS error
FROM (SELECT doc_id, t, CAST('0x' || substr(md5(t), 1, 2) AS INT) % 4 AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


@query(STUB_SQL)
def vlm_infer_stub(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generate_plans(docs).select("doc_id", "output_text", "error")


@query(STUB_SQL)
def batched_plans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generate_batches(docs, cells=1 << 20).select("doc_id", "output_text", "error")


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\S+')) AS y FROM conversations)
SELECT conv_id, turn, len(list_intersect(y, ['the', 'and', 'of']))::DOUBLE / len(list_distinct(list_concat(y, ['the', 'and', 'of']))) AS score FROM t""")
def pair_scores(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("the and of").alias("a"), "text")
    return score_pairs(rows, "a", "text").select("conv_id", "turn", "score")


# Raw traces: truth and predictions as JSON and text


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'SELECT' WHEN 3 THEN 'HOVER' ELSE '' END AS true_operation,
CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'Item ' || event_id WHEN 2 THEN 'V' || event_id ELSE '' END AS true_value,
CASE event_id % 3 WHEN 0 THEN '[x] ' || event_id ELSE 'r0 | r' || event_id END AS true_element,
CASE event_id % 3 WHEN 0 THEN '' || event_id WHEN 1 THEN event_id || ',m' || event_id ELSE 'm' || event_id END AS true_ids,
CASE event_id % 4 WHEN 0 THEN '' || event_id WHEN 1 THEN 'b' || event_id ELSE '' END AS predicted_id FROM events""")
def truth_fields(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    n = i.cast("string")
    of = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    operation = (
        F.when(i % 5 == 0, '{"op":"click","value":" a "}')
        .when(i % 5 == 1, of('{"op":"TYPE","value":" Item ', n, ' "}'))
        .when(i % 5 == 2, of('{"action_type":"select","action_input":"V', n, '"}'))
        .when(i % 5 == 3, " Hover ")
    )
    candidates = (
        F.when(i % 3 == 0, F.array(of('{"backend_node_id":"', n, '","attributes":{"backend_node_id":"', n, '"}}')))
        .when(i % 3 == 1, F.array(of('{"backend_node_id":"', n, '","attributes":{"backend_node_id":"m', n, '"}}')))
        .otherwise(F.array(F.lit("broken"), of('{"attributes":{"backend_node_id":"m', n, '"}}')))
    )
    attributes = F.create_map(F.lit("backend_node_id"), F.when(i % 4 == 1, of("b", n)))
    selected = F.struct(F.when(i % 4 == 0, n).when(i % 4 == 2, "").alias("backend_node_id"), attributes.alias("attributes"))
    return e.select(
        "event_id",
        jsonfn.truth_operation(operation).alias("true_operation"),
        jsonfn.truth_value(operation).alias("true_value"),
        text.element_label(F.when(i % 3 == 0, of(" [x] ", n, " ")).otherwise(""), F.array(F.lit("r0"), of("r", n))).alias("true_element"),
        F.array_join(jsonfn.truth_ids(candidates), ",").alias("true_ids"),
        match.chosen_id(selected).alias("predicted_id"),
    )


@query("""WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n FROM conversations),
k AS (SELECT *, (['CLICK', 'TYPE', 'SCROLL'])[n % 3 + 1] AS t FROM c WHERE n % 7 <> 0),
f AS (SELECT conv_id, turn, n % 11 <> 0 AS operation_match, n % 5 <> 0 AND n % 4 <> 0 AS element_match, t <> 'TYPE' OR (n % 11 <> 0 AND n % 2 = 0) AS value_match FROM k)
SELECT conv_id AS annotation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_index, operation_match, element_match, value_match, operation_match AND element_match AND value_match AS step_success FROM f""")
def step_records(spark, sf):
    c, n = table(spark, sf, "conversations"), F.col("n")
    rows = c.select(F.col("conv_id").alias("annotation_id"), F.col("turn").alias("step_index"), "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    kind = F.element_at(F.array(*map(F.lit, ("CLICK", "TYPE", "SCROLL"))), (n % 3 + 1).cast("int"))
    node = (n % 10).cast("string")
    steps = rows.select(
        "annotation_id", "step_index", F.col("role").alias("confirmed_task"), F.lit("w").alias("website"), F.lit("d").alias("domain"),
        F.to_json(F.struct(kind.alias("op"), F.concat(F.lit("V"), n.cast("string")).alias("value"))).alias("operation"),
        F.when(n % 5 == 0, F.array(F.lit("{}"))).otherwise(F.array(F.to_json(F.struct(node.alias("backend_node_id"))))).alias("pos_candidates"),
        F.lit("").alias("target_action_reprs"), F.array(F.lit("r")).alias("action_reprs"),
    )
    plan = F.when(n % 11 == 0, "").when(kind == "TYPE", F.concat(F.lit('type: Enter "'), F.when(n % 2 == 0, "v").otherwise("w"), n.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("ACTION_TYPE: "), F.lower(kind)))
    selected = F.struct(F.when(n % 4 != 0, node).alias("backend_node_id"), F.create_map(F.lit("id"), F.lit("x")).alias("attributes"))
    outputs = rows.select("annotation_id", "step_index", plan.alias("plan"), selected.alias("selected"), F.lit(1.0).alias("latency"), F.when(n % 7 == 0, "timeout").alias("error"))
    flags = ["operation_match", "element_match", "value_match", "step_success"]
    return match.step_records(steps, outputs).select("annotation_id", F.col("step_index").cast("long").alias("step_index"), *flags)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'scroll' WHEN 1 THEN 'click' WHEN 2 THEN 'click' WHEN 4 THEN 'noop' END AS action_type,
CASE event_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 4 THEN 0.25::DOUBLE END AS confidence, event_id % 5 <> 3 AS success FROM events""")
def mended_actions(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    raw = (
        F.when(i % 5 == 0, '{"action_type":"fly","action":"scroll","confidence":1.7}')
        .when(i % 5 == 1, '{"action_type":"click","target":{"selector":"#a"},"confidence":-2}')
        .when(i % 5 == 2, '{"action_type":"click","target":{"selector":"#a"},"confidence":"high"}')
        .when(i % 5 == 3, '{"action_type":"type","target":{"selector":"#a"},"value":"","confidence":0.5}')
        .otherwise('{"confidence":0.25}')
    )
    return decode.decode_actions(e.select("event_id", raw.alias("raw")), "raw").select("event_id", "action.action_type", "action.confidence", "success")


@query("""WITH g AS (SELECT event_id, 100 + event_id % 900 AS w, 50 + event_id % 700 AS h, event_id % 100 / 100 AS x, event_id % 50 / 50 AS y FROM events),
s AS (SELECT *, least(640::DOUBLE / w, 480::DOUBLE / h) AS k FROM g), p AS (SELECT *, floor((640 - floor(w * k)) / 2) AS px, floor((480 - floor(h * k)) / 2) AS py FROM s)
SELECT event_id, x * w AS left_px, y * h AS top_px, (x * w + 10 - px) / k AS old_x, (y * h + 10 - py) / k AS old_y, event_id % 7 + 1.5::DOUBLE AS corner_x, event_id % 3 + 4::DOUBLE AS corner_y FROM p""")
def mapped_boxes(spark, sf):
    i = F.col("event_id")
    w, h = (100 + i % 900).cast("double"), (50 + i % 700).cast("double")
    rows = table(spark, sf, "events").select("event_id", w.alias("w"), h.alias("h"), (i % 100 / 100).alias("x"), (i % 50 / 50).alias("y"))
    box = geometry.scaled(F.array("x", "y", F.lit(0.5), F.lit(0.5)), F.col("w"), F.col("h"), 4)
    frame = geometry.fit(F.col("w"), F.col("h"), 640, 480)
    old = geometry.to_original(F.array(F.col("box")[0] + 10, F.col("box")[1] + 10, F.lit(1.0), F.lit(1.0)), frame)
    corners = geometry.box_corners(F.concat(F.lit("["), (i % 7).cast("string"), F.lit(", "), (i % 3).cast("string"), F.lit(", 1.5, 4]")))
    out = rows.select("*", box.alias("box")).select("event_id", "box", old.alias("old"), corners.alias("corners"))
    return out.select("event_id", *(F.col(c)[k].alias(a) for c, k, a in (("box", 0, "left_px"), ("box", 1, "top_px"), ("old", 0, "old_x"), ("old", 1, "old_y"), ("corners", 2, "corner_x"), ("corners", 3, "corner_y"))))


@query("""SELECT event_id, 'look [see attached screenshot] at ' || event_id AS plain,
'{"role":"user","content":[' || CASE WHEN event_id % 2 = 0 THEN '{"type":"image_url","url":"http://x/' || event_id || '"},' ELSE '' END || '{"type":"text","text":"do ' || event_id || '"}]}' AS message,
'Instruction: go ' || event_id || chr(10) || 'Action: click' || chr(10) || chr(10) || 'Instruction: ' || chr(10) || 'Action: type' AS shots FROM events""")
def chat_prompts(spark, sf):
    n = F.col("event_id").cast("string")
    examples = F.array(F.struct(F.concat(F.lit("go "), n).alias("instruction"), F.lit("click").alias("response")), F.struct(F.lit(None).cast("string").alias("instruction"), F.lit("type").alias("response")))
    return table(spark, sf, "events").select(
        "event_id",
        text.without_vision_tokens(F.concat(F.lit(" look <|vision_start|>a\nb<|vision_end|> at "), n, F.lit("<|image_pad|> "))).alias("plain"),
        text.chat_message(F.concat(F.lit("do "), n), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("http://x/"), n))).alias("message"),
        text.few_shot(examples).alias("shots"),
    )


# Parsing, writing and listing


def _by(rows, column, *choices):
    """The choice of a row by its number modulo their count."""
    out = choices[-1]
    for k in reversed(range(len(choices) - 1)):
        out = F.when(F.col(column) % len(choices) == k, choices[k]).otherwise(out)
    return rows.withColumn("raw", out)


def _text(*parts):
    """Strings as literals and columns as text, in one."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'type' END AS action_type,
CASE event_id % 4 WHEN 1 THEN 'Keys not found: target' WHEN 2 THEN 'Keys not found: action_type, target' WHEN 3 THEN 'Empty input text' END AS error FROM events""")
def required_keys(spark, sf):
    rows = _by(table(spark, sf, "events"), "event_id", F.lit('{"action_type":"click","target":null}'), F.lit('say {"action_type":"type",} now'), F.lit('{"value":1}'), F.lit(""))
    parsed = jsonfn.parse_json(rows.select("event_id", "raw"), "raw", "p")
    return parsed.select("event_id", F.get_json_object("p.json", "$.action_type").alias("action_type"), jsonfn.required_error(F.col("p.json"), F.col("p.error"), ("action_type", "target")).alias("error"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"action_type":"click","target":null,"value":null,"confidence":0.5}'
WHEN 1 THEN '{"action_type":"noop","target":{"selector":"#a' || event_id || '"},"value":null,"confidence":0.0}'
ELSE '{"action_type":"noop","target":null,"value":"v' || event_id || '","confidence":null}' END AS action FROM events""")
def action_round_trip(spark, sf):
    n = F.col("event_id")
    rows = _by(table(spark, sf, "events"), "event_id", F.lit('{"action_type":"click","confidence":0.5}'), _text('{"target":{"selector":"#a', n, '"}}'), _text('{"value":"v', n, '","confidence":null}'))
    return rows.select("event_id", decode.to_text(decode.from_text(decode.to_text(decode.from_text(F.col("raw"))))).alias("action"))


@query("SELECT event_id, 'click' AS kind FROM events")
def strict_factory(spark, sf):
    rows = table(spark, sf, "events").select("event_id", _text('{"selector":"#', F.col("event_id"), '"}').alias("target"))
    error = decode.prediction_error(F.lit("click"), F.col("target"), F.lit(0.5), F.lit(None).cast("string"))
    return rows.select("event_id", decode.require_valid(error, F.lit("click")).alias("kind"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 2 THEN 'scroll' WHEN 4 THEN 'select' END AS action,
CASE event_id % 6 WHEN 1 THEN 0.5::DOUBLE WHEN 4 THEN 0.25::DOUBLE END AS confidence, event_id % 6 <> 5 AS found FROM events""")
def labelled_answers(spark, sf):
    rows = _by(
        table(spark, sf, "events"),
        "event_id",
        _text('Thought {x}\nOutput: {"action":"click","n":', F.col("event_id"), "} done"),
        F.lit(' {"action":"type","confidence":0.5} '),
        F.lit('first {bad} then {"action":"scroll","target":{"selector":"#a"}} or {"action":"x"}'),
        F.lit('deep {"action":"hover","t":{"u":{"v":1}}} end'),
        F.lit('"action": "select", "value": null, "confidence": 0.25'),
        F.lit("nothing to read"),
    )
    found = rows.select("event_id", jsonfn.extract_json("raw").alias("j"))
    return found.select("event_id", F.get_json_object("j", "$.action").alias("action"), F.get_json_object("j", "$.confidence").try_cast("double").alias("confidence"), F.col("j").isNotNull().alias("found"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pay ' || event_id WHEN 1 THEN 'b ' || event_id WHEN 2 THEN 'x' END AS probe FROM events""")
def embedded_answers(spark, sf):
    n = F.col("event_id")
    rows = _by(table(spark, sf, "events"), "event_id", _text('Selected element: {"text": "pay ', n, '"}'), _text("I say Selected element [ {'attributes': {'id': 'b', 'k': '", n, "'}}"), F.lit('{"text":"","attributes":{"a":"x","b":""}}'), F.lit("Selected element: {oops}"), F.lit(""))
    return rows.select("event_id", ranking.answer_probe("raw").alias("probe"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\":' || event_id || '}' ELSE '{\"raw\":\"' || event_type || '\"}' END AS loaded FROM events")
def json_or_raw(spark, sf):
    rows = _by(table(spark, sf, "events"), "event_id", _text('{"k":', F.col("event_id"), "}"), F.col("event_type"))
    return rows.select("event_id", jsonfn.load_or_raw(F.col("raw")).alias("loaded"))


@query("SELECT event_type, coalesce(bool_and(value > 1), true) AS ok FROM events GROUP BY event_type")
def all_succeeded(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(metrics.all_succeeded(F.col("value") > 1).alias("ok"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_custkey IS NOT NULL")
def checkpoint_ids(spark, sf):
    return checkpoint.listed(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT count(DISTINCT o_custkey) AS total FROM orders")
def checkpoint_count(spark, sf):
    return checkpoint.counted(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, sf):
    return sampling.row_count(table(spark, sf, "lineitem"))


@query("""(SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 10) UNION ALL (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1 OFFSET 1)""")
def positional_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sampling.row_at(rows, ["o_orderkey"], 10).unionByName(sampling.row_at(rows, ["o_orderkey"], -2))


@query("""SELECT text AS instruction, role AS operation, CAST(conv_id AS VARCHAR) AS annotation_id, conv_id || '-' || turn AS action_uid, 'unknown' AS website FROM conversations""")
def sample_views(spark, sf):
    none = F.lit(None)
    rows = table(spark, sf, "conversations").select(
        F.col("text").alias("confirmed_task"), F.col("role").alias("operation"), F.col("conv_id").cast("string").alias("annotation_id"), _text(F.col("conv_id"), "-", F.col("turn")).alias("action_uid"),
        none.cast("array<string>").alias("pos_candidates"), none.cast("binary").alias("screenshot"), none.cast("string").alias("cleaned_html"),
    )
    for column, default in (("website", "unknown"), ("domain", None), ("operation", "never")):
        rows = with_default(rows, column, "string", default)
    return sampling.sample_view(rows).select("instruction", "operation", "metadata.annotation_id", "metadata.action_uid", "metadata.website")


@query("""SELECT conv_id AS annotation_id, turn AS step_index, CAST(2 - GROUPING(conv_id) - GROUPING(turn) AS INT) AS level, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens,
sum(CASE WHEN big THEN p * 2500000 + c * 10000000 ELSE p * 150000 + c * 600000 END)::DOUBLE / 1e12 AS cost_usd, count(*) AS calls
FROM (SELECT conv_id, turn, coalesce(length(text), 0) AS p, turn + 1 AS c, conv_id % 2 = 0 AS big FROM conversations) GROUP BY ROLLUP (conv_id, turn)""")
def cost_rollup(spark, sf):
    model = F.when(F.col("conv_id") % 2 == 0, "gpt-4o").otherwise("gpt-4o-mini")
    calls = table(spark, sf, "conversations").select(F.col("conv_id").alias("annotation_id"), F.col("turn").alias("step_index"), model.alias("model"), F.length("text").alias("prompt_tokens"), (F.col("turn") + 1).alias("completion_tokens"))
    return cost.totals(calls)


# Elements, boxes and images


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS tag, event_id % 3 = 0 AS is_original_target, CASE WHEN event_id % 3 = 0 THEN '' || event_id END AS backend_node_id,
CASE WHEN event_id % 3 = 0 THEN (event_id % 7) * 2::DOUBLE END AS x1, CASE WHEN event_id % 3 = 0 THEN 1::DOUBLE END AS y1, CASE WHEN event_id % 3 = 0 THEN (event_id % 7 + 10) * 2::DOUBLE END AS x2, CASE WHEN event_id % 3 = 0 THEN 3::DOUBLE END AS y2 FROM events""")
def candidate_boxes(spark, sf):
    n = F.col("event_id")
    rows = _by(table(spark, sf, "events"), "event_id", _text('{"tag":"a","is_original_target":true,"backend_node_id":"', n, '","attributes":"{\\"bounding_box_rect\\":\\"', n % 7, ',2,10,4\\"}"}'), F.lit('{"tag":"b","attributes":{"bounding_box":"1,2,3"}}'), F.lit("broken"))
    c = candidates(F.col("raw"), F.lit(2.0), F.lit(0.5))
    out = rows.select("event_id", c.alias("c"))
    return out.select("event_id", "c.tag", "c.is_original_target", "c.backend_node_id", *(F.get("c.bbox_xyxy", F.lit(k)).alias(a) for k, a in enumerate(("x1", "y1", "x2", "y2"))))


@query("""SELECT event_id, 4::BIGINT AS n_elements, 'hi ' || event_id || ' go' AS first_text, 'd' AS first_id, 'k' AS first_class, 'one two' AS third_text, 1::BIGINT AS n_candidates, '' || event_id AS node, 0::BIGINT AS n_ocr FROM events""")
def processed_pages(spark, sf):
    n = F.col("event_id")
    page = _text('<!-- c --><div id="d" class="k"> hi ', n, ' <a href="x"> go</a></div></span><script>s</script><p>one<p>two')
    rows = with_page(table(spark, sf, "events").select("event_id", page.alias("cleaned_html"), F.array(_text('{"backend_node_id":"', n, '"}')).alias("pos_candidates")))
    at = lambda k, f: F.get("dom_elements", F.lit(k))[f]
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "event_id", size("dom_elements").alias("n_elements"), at(0, "text").alias("first_text"), at(0, "id").alias("first_id"), at(0, "class").alias("first_class"), at(2, "text").alias("third_text"),
        size("candidates").alias("n_candidates"), F.get("candidates", F.lit(0))["backend_node_id"].alias("node"), size("ocr_tokens").alias("n_ocr"),
    )


#: Every way in which an element can be one that a user acts on, and one that isn't.
_ACTIVE = [(t, "") for t in ("button", "a", "input", "select", "textarea", "label")]
_ACTIVE += [("div", f"role={r}") for r in ("button", "tab", "menuitem", "option", "link", "checkbox", "radio", "switch", "combobox", "listbox")]
_ACTIVE += [("i", f"{a}=1") for a in ("tabindex", "onclick", "backend_node_id")] + [("div", "role=none")]
_ACTIVE_SQL = " ".join(f"WHEN {k} THEN '<{t}> text=''{'' if t == 'input' else 't'}'' attrs={{" + (f"''{a.split('=')[0]}'': ''{a.split('=')[1]}''" if a else "") + "}'" for k, (t, a) in enumerate(_ACTIVE[:-1]))


@query(f"SELECT event_id, CASE WHEN event_id % {len(_ACTIVE)} < {len(_ACTIVE) - 1} THEN 1 ELSE 0 END::BIGINT AS n, CASE event_id % {len(_ACTIVE)} {_ACTIVE_SQL} END AS representation FROM events")
def active_elements(spark, sf):
    rows = _by(table(spark, sf, "events"), "event_id", *(F.lit(f"<p><{t} {a}>t</{t}></p>") for t, a in _ACTIVE))
    rows = rows.select("event_id", interactive_elements("raw").alias("e"))
    return rows.select("event_id", F.size("e").cast("long").alias("n"), F.get("e", F.lit(0))["representation"].alias("representation"))


@query("""SELECT event_id, (event_id % 3) || '. <a> text="Item ' || event_id || '" attrs={''role'': ''button''} (score: 0.5000)' AS line,
'Pick.' || chr(10) || chr(10) || '1. <a> "Item ' || event_id || '" class=big' || chr(10) || '2. <p> "" class=' || chr(10) || chr(10) || 'Instruction: go' || chr(10) || 'Action: click' || chr(10) || chr(10) || 'now ' || event_id AS prompt FROM events""")
def prompt_parts(spark, sf):
    n = F.col("event_id")
    attributes = lambda *kv: F.create_map(*map(F.lit, kv))
    element = lambda tag, t, *kv: F.struct(F.lit(tag).alias("tag"), t.alias("text"), attributes(*kv).alias("attributes"))
    rows = table(spark, sf, "events").select("event_id", element("a", _text(" Item  ", n), "role", "button", "class", "big").alias("e"), element("p", F.lit(""), "id", "x").alias("f"))
    shots = F.array(F.struct(F.lit("go").alias("instruction"), F.lit("click").alias("response")))
    return rows.select("event_id", text.candidate_line((n % 3).cast("int"), F.col("e"), F.lit(0.5)).alias("line"), text.decode_prompt(F.lit("Pick."), F.array("e", "f"), shots, _text("now ", n)).alias("prompt"))


@query("""WITH s AS (SELECT event_id, 100 + event_id % 3000 AS w, 50 + event_id % 2000 AS h FROM events), k AS (SELECT *, CASE WHEN w > 1024 OR h > 1024 THEN least(1::DOUBLE, least(768::DOUBLE / w, 512::DOUBLE / h)) ELSE 1::DOUBLE END AS s FROM s)
SELECT event_id, CAST(floor(w * s) AS BIGINT) AS small_w, CAST(floor(h * s) AS BIGINT) AS small_h, 640::DOUBLE / w AS scale_x, 320 / (640::DOUBLE / w) AS old_x, 240 / (480::DOUBLE / h) AS old_y, ((event_id % 256)::FLOAT / 255::FLOAT)::DOUBLE AS pixel,
CASE WHEN event_id % 4 > 0 THEN event_id % 4 + 0.5::DOUBLE END AS target_sum FROM k""")
def image_frames(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", (100 + i % 3000).alias("w"), (50 + i % 2000).alias("h"))
    small, frame = geometry.downscaled(F.col("w"), F.col("h"), (1024, 1024), (768, 512)), geometry.stretch(F.col("w"), F.col("h"), 640, 480)
    target = geometry.numbers(F.concat(F.when(i % 4 > 0, (i % 4).cast("string")).otherwise("x"), F.lit(", 0.5")))
    rows = rows.select("event_id", small.alias("small"), frame.alias("frame"), geometry.unit_pixels(F.array((i % 256).cast("int"))).alias("pixels"), target.alias("target"))
    old = geometry.unstretched(F.array(F.lit(320.0), F.lit(240.0)), F.col("frame"))
    return rows.select("event_id", F.col("small.width").alias("small_w"), F.col("small.height").alias("small_h"), "frame.scale_x", old[0].alias("old_x"), old[1].alias("old_y"), F.get("pixels", F.lit(0)).cast("double").alias("pixel"), (F.get("target", F.lit(0)) + F.get("target", F.lit(1))).alias("target_sum"))


# Large selections, images as pixels


@query("""SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5(l_orderkey || '-' || l_linenumber || '|7'), l_orderkey || '-' || l_linenumber
LIMIT (SELECT CAST(floor(count(*) * 0.6 + 0.5) AS BIGINT) FROM lineitem)""")
def split_sample(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return sampling.sample_fraction(rows, "key", 0.6, 7).drop("key")


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY l_shipdate NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT l_shipdate, l_orderkey, l_linenumber FROM o WHERE i = n // 2 OR i = n - n // 4""")
def rows_far_inside(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    rows = table(spark, sf, "lineitem").select(*order)
    n = rows.count()
    return sampling.row_at(rows, order, n // 2).unionByName(sampling.row_at(rows, order, -(n // 4)))


PAGE_IMAGES_SQL = """WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '[^\\x01-\\x7F]', '?', 'g') AS t FROM pages),
h AS (SELECT page_id, t, CAST(greatest(4, (length(t) + 63) // 64 * 4) AS INT) AS height FROM p),
c AS (SELECT page_id, height, unnest(string_split(rpad(t, 16 * height, ' '), '')) AS c, unnest(range(0, 16 * height)) AS k FROM h),
v AS (SELECT page_id, height, k // 64 * 4 + k % 16 // 4 AS cell, sum(unicode(c)) AS s FROM c GROUP BY ALL),
w AS (SELECT page_id, height, CAST(sum(s) AS BIGINT) AS total, CAST(sum((cell + 1) * floor(s / 16 + 0.5)) AS BIGINT) AS small_sum FROM v GROUP BY ALL)
SELECT page_id, CASE WHEN page_id % 10 > 0 THEN 16 END AS width, CASE WHEN page_id % 10 > 0 THEN height END AS height, CASE WHEN page_id % 10 > 0 THEN total END AS total,
CASE WHEN page_id % 10 > 0 THEN height // 4 END AS small_height, CASE WHEN page_id % 10 > 0 THEN small_sum END AS small_sum, page_id % 10 = 0 AS broken FROM w"""


@query(PAGE_IMAGES_SQL)
def page_images(spark, sf):
    """Pages as grey pictures (PNG, every tenth cut off), decoded and made smaller by 4."""
    t = F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x01-\x7F]", "?")
    height = F.greatest(F.lit(4), F.floor((F.char_length("t") + 63) / 64) * 4).cast("int")
    rows = table(spark, sf, "pages").select("page_id", t.alias("t")).withColumn("h", height)
    raw = F.concat(F.lit("P5 16 "), F.col("h").cast("string"), F.lit(" 255\n"), F.rpad("t", 16 * F.col("h"), F.lit(" "))).cast("binary")
    shot = rows.select("page_id", "h", images.as_png(raw).alias("png"))
    cut = F.when(F.col("page_id") % 10 == 0, F.substring("png", 1, 60)).otherwise(F.col("png"))
    both = shot.select("page_id", "h", cut.alias("png")).select("page_id", images.decoded(F.col("png")).alias("d"), images.prepared(F.col("png"), F.lit(4), (F.col("h") / 4).cast("int"), pad=False, unit=False, rgb=False).alias("s"))
    total = F.aggregate("d.pixels", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    weighed = F.aggregate(F.transform("s.pixels", lambda x, i: (i + 1) * x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return both.select("page_id", "d.width", "d.height", total.alias("total"), F.col("s.height").alias("small_height"), weighed.alias("small_sum"), (F.col("d.error").isNotNull() & F.col("s.error").isNotNull()).alias("broken"))


@query("SELECT event_id, array_to_string(range(0, least(event_id % 8 + 1, 5)), ',') AS shown FROM events")
def candidate_preview(spark, sf):
    all_of_them = F.sequence(F.lit(0), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select("event_id", F.array_join(ranking.preview(all_of_them), ",").alias("shown"))


# Uncertainty, merged states, fields that no query above shows

_INTERVAL_NAMES = [*metrics.STEP_FLAGS, "offline0_rate", "offline1_rate"]
_INTERVAL_SUMS = ", ".join(f"sum(p_{n} * w)::DOUBLE / sum(w_{n} * w) AS {n}" for n in _INTERVAL_NAMES)
_INTERVAL_PARTS = ", ".join(f"count_if({flag}) AS p_{n}, count(*) AS w_{n}" for n, flag in metrics.STEP_FLAGS.items())


@query(f"""WITH {STEPS_SQL}, k AS (SELECT annotation_id, {_INTERVAL_PARTS}, bool_and(step_success)::INT AS p_offline0_rate, 1 AS w_offline0_rate, (count_if(NOT step_success) <= 1)::INT AS p_offline1_rate, 1 AS w_offline1_rate FROM s GROUP BY annotation_id),
r AS (SELECT unnest(range(0, 200)) AS replicate), d AS (SELECT k.*, replicate, ('0x' || substr(md5(coalesce(CAST(annotation_id AS VARCHAR), '') || '|42|' || (replicate // 4)), 8 * (replicate % 4) + 1, 8))::BIGINT AS u FROM k, r),
w AS (SELECT *, {" + ".join(f"(u >= {t})::INT" for t in uncertainty.thresholds())} AS w FROM d UNION ALL SELECT *, -1, 0, 1 FROM k),
b AS (SELECT replicate, {_INTERVAL_SUMS} FROM w WHERE w > 0 GROUP BY replicate), l AS (UNPIVOT b ON {", ".join(_INTERVAL_NAMES)} INTO NAME metric VALUE rate),
g AS (SELECT metric, max(rate) FILTER (replicate = -1) AS estimate, list_sort(list(rate) FILTER (replicate >= 0)) AS x FROM l GROUP BY metric)
SELECT metric, estimate, x[CAST(floor(len(x) * 0.025 + 1e-9) AS INT) + 1] AS low, x[CAST(ceil(len(x) * 0.975 - 1e-9) AS INT)] AS high FROM g""")
def rate_intervals(spark, sf):
    """95 % intervals of step and task rates, tasks drawn 200 times."""
    rates = {name: (F.count_if(flag), F.count(F.lit(1))) for name, flag in metrics.STEP_FLAGS.items()}
    rates |= {"offline0_rate": (F.bool_and("step_success").cast("int"), F.lit(1)), "offline1_rate": ((F.count_if(~F.col("step_success")) <= 1).cast("int"), F.lit(1))}
    return uncertainty.intervals(match.step_flags(derive.recorded_steps(spark, sf)), "annotation_id", rates)


@query(f"""WITH {ACTION_PAIRS_SQL} SELECT event_type, count(*) AS total, count_if(action_match) AS action_match_count, count_if(overall_match) AS overall_match_count, avg(action_match::INT) AS action_match_rate, avg(overall_match::INT) AS overall_match_rate, true AS near
FROM f JOIN events USING (event_id) GROUP BY event_type""")
def merged_states(spark, sf):
    """Seven batches kept as states and merged; the median is held against all rows."""
    flags = match.action_flags(derive.action_pairs(spark, sf)).select("event_id", "action_match", "overall_match")
    rows = flags.join(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id")
    states = state.state(rows.withColumn("batch", F.col("event_id") % 7), ["event_type", "batch"], ("action_match", "overall_match"), "value")
    told = state.rates(state.merged(states.drop("batch"), ["event_type"]))
    v, m, n = F.col("value"), F.col("time_50"), F.count("value")
    held = table(spark, sf, "events").select("event_type", "value").join(F.broadcast(told.select("event_type", "time_50")), "event_type").groupBy("event_type")
    near = held.agg(((F.count_if(v < m) <= 0.52 * n) & (F.count_if(v <= m) >= 0.48 * n)).alias("near"))
    return told.drop("time_50", "mean_time").join(near, "event_type")


@query(f"""WITH {STEPS_SQL}, r AS (SELECT annotation_id, step_index, instruction, p, CASE WHEN n % 19 = 0 THEN '' WHEN n % 6 = 0 THEN '99' ELSE '' || n % 10 END AS node, CASE WHEN n % 4 = 0 THEN ' v' || n || ' ' ELSE 'other' END AS value FROM q)
SELECT annotation_id, string_agg(concat_ws('/', step_index, instruction, p, node, value, operation_match, element_match, value_match, step_success), ';' ORDER BY step_index) AS steps FROM r JOIN s USING (annotation_id, step_index, instruction) GROUP BY annotation_id""")
def nested_records(spark, sf):
    """Every field of a task's nested steps."""
    columns = ("instruction", "predicted_operation", "predicted_id", "predicted_value", "operation_match", "element_match", "value_match", "step_success")
    nested = metrics.nested_steps(match.step_flags(derive.recorded_steps(spark, sf)), columns=columns)
    line = lambda s: F.concat_ws("/", *(s[c].cast("string") for c in ("step_index", *columns)))
    return nested.select("annotation_id", F.array_join(F.transform("steps", line), ";").alias("steps"))


@query(f"WITH {STEPS_SQL} SELECT annotation_id, step_index FROM s WHERE NOT element_match")
def step_failures(spark, sf):
    return metrics.failures(match.step_flags(derive.recorded_steps(spark, sf)), "element_match").select("annotation_id", "step_index")


@query(f"""WITH {ACTION_PAIRS_SQL}, a AS (SELECT oracle_action_type, avg(overall_match::INT) FILTER (event_id % 2 = 0) AS original, avg(overall_match::INT) FILTER (event_id % 2 = 1) AS perturbed FROM f GROUP BY oracle_action_type)
SELECT oracle_action_type, original, perturbed, CASE WHEN original <> 0 THEN (original - perturbed) / original END AS "drop" FROM a WHERE original IS NOT NULL AND perturbed IS NOT NULL""")
def robustness(spark, sf):
    flags = match.action_flags(derive.action_pairs(spark, sf))
    run = lambda k: metrics.by_action_type(flags.where(F.col("event_id") % 2 == k))
    return metrics.robustness_drop(run(0), run(1), ["oracle_action_type"], "overall_match_rate")


@query(f"""WITH {STEPS_SQL}, k AS (SELECT annotation_id, avg(step_success::INT) AS steps, bool_and(step_success)::INT AS task, CAST(count_if(element_match) * 5 + count_if(operation_match) * 3 + count_if(value_match) * 2 AS DOUBLE) / (10 * count(*)) AS grounding FROM s GROUP BY annotation_id)
SELECT annotation_id, round(grounding, 9) AS grounding, round(steps * task * grounding, 9) AS final_score FROM k""")
def final_scores(spark, sf):
    steps = match.step_flags(derive.recorded_steps(spark, sf))
    score = metrics.grounding_score({"element_match": 0.5, "operation_match": 0.3, "value_match": 0.2})
    tasks = steps.groupBy("annotation_id").agg(F.avg(F.col("step_success").cast("int")).alias("steps"), F.bool_and("step_success").cast("int").alias("task"), F.avg(score).alias("grounding"))
    # Sums of doubles depend on their order, so both are rounded for the comparison.
    return tasks.select("annotation_id", F.round("grounding", 9).alias("grounding"), F.round(metrics.final_score(F.col("steps"), F.col("task"), F.col("grounding")), 9).alias("final_score"))


@query(f"WITH {STEPS_SQL} SELECT annotation_id, count_if(n % 7 = 0 AND t <> p)::DOUBLE / count(*) AS corrected FROM q GROUP BY annotation_id")
def correction_rates(spark, sf):
    """Every step whose text's length 7 divides was corrected to its true operation."""
    steps = derive.recorded_steps(spark, sf)
    right = F.when(F.col("n") % 7 == 0, F.col("true_operation"))
    return steps.groupBy("annotation_id").agg(metrics.correction_rate(F.col("predicted_operation"), right).alias("corrected"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"action_type":"click","target":{"selector":"#p' || event_id || '"},"confidence":0.5, "value": null}' WHEN 1 THEN '{"action_type":"scroll","target":null,"confidence":' || event_id % 2 || ', "value": null}' END AS parsed,
event_id % 3 <> 2 AS success, event_id % 3 = 2 AS failed FROM events""")
def decoded_with_metadata(spark, sf):
    """What was parsed, with the missing value filled in, beside the verdict."""
    n = F.col("event_id")
    rows = _by(table(spark, sf, "events"), "event_id", _text('{"action_type":"click","target":{"selector":"#p', n, '"},"confidence":0.5}'), _text('{"action_type":"scroll","target":null,"confidence":', n % 2, "}"), _text("nothing in ", n))
    out = decode.decode_actions(rows.select("event_id", "raw"), "raw", strict=True)
    return out.select("event_id", "parsed", "success", F.col("error").isNotNull().alias("failed"))


@query("""WITH p AS (SELECT page_id, 400 + page_id % 200 AS n FROM pages)
SELECT page_id, CAST(least(n, 500) AS BIGINT) AS n_summary, 'e' || least(n, 500) - 1 AS last_summary, 50::BIGINT AS n_lines, '50. <p> "e49" class=' AS last_line FROM p""")
def page_limits(spark, sf):
    """Pages of 400 to 599 elements beside their own html: 500 are summed up, 50 listed."""
    size = (400 + F.col("page_id") % 200).cast("int")
    items = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.concat(F.lit("<p>e"), k.cast("string"), F.lit("</p>"))), "")
    rows = table(spark, sf, "pages").select("page_id", dom_summary(items).alias("e"))
    element = lambda e: F.struct(e["tag"].alias("tag"), e["text"].alias("text"), e["attrs"].alias("attributes"))
    lines = F.split(text.dom_lines(F.transform("e", element)), "\n")
    return rows.select("page_id", F.size("e").cast("long").alias("n_summary"), F.element_at("e", -1)["text"].alias("last_summary"), F.size(lines).cast("long").alias("n_lines"), F.element_at(lines, -1).alias("last_line"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(length(text), 0) AS p, coalesce(length(text), 0) % 7 + 1 AS o FROM conversations)
SELECT conv_id AS annotation_id, turn AS step_index, CAST(2 - GROUPING(conv_id) - GROUPING(turn) AS INT) AS level, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS completion_tokens, CAST(sum(p + o) AS BIGINT) AS total_tokens,
sum(p * 2500000 + o * 10000000)::DOUBLE / 1e12 AS cost_usd, count(*) AS calls FROM c GROUP BY ROLLUP (conv_id, turn)""")
def billed_rollup(spark, sf):
    """Calls of a model that counts characters, four at a time, and what they cost."""

    def counting():
        return lambda prompt, image, tokens: Answer("ACTION_TYPE: click", len(prompt), len(prompt) % 7 + 1)

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("annotation_id"), F.col("turn").alias("step_index"), F.col("text").alias("prompt"))
    return cost.totals(billed_calls(rows, "r1", "gpt-4o", ("annotation_id", "step_index"), counting))
