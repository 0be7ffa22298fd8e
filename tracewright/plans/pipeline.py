"""The whole evaluation of recorded or generated outputs, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.html import interactive_elements
from ..functions.text import choice_prompt, or_empty, step_prompt
from ..models import generate_plans, score_pairs, strict_retry, stub_generator, word_overlap_scorer
from ..operators.checkpoint import pending
from ..operators.history import running_history
from ..operators.match import step_records
from ..operators.metrics import corpus_metrics, task_metrics
from ..operators.ranking import answer_probe, choose_element, top_candidates


def ground(plans: DataFrame, settings: Settings = Settings(), scorer=word_overlap_scorer, answers=None) -> DataFrame:
    """Rows of (annotation_id, step_index, plan, cleaned_html, and instruction if known) with the ``selected`` element.

    Elements are scored against the plan in batches, cut to the best k per step
    before they are grouped again, and ``answers`` (a factory of a chooser) may
    name one of them, by index or by an object with its text, and is asked once more
    if its answer can't be read; without it the best scored is taken.
    """
    if "instruction" not in plans.columns:
        plans = plans.withColumn("instruction", F.lit(""))
    key = ["annotation_id", "step_index", "instruction", "plan"]
    step = F.concat_ws("|", "annotation_id", F.col("step_index").cast("string"))
    rows = plans.select(*key, step.alias("step"), F.explode(interactive_elements("cleaned_html")).alias("element"))
    scored = score_pairs(rows.withColumn("representation", F.col("element.representation")), "plan", "representation", scorer, settings.pair_batch)
    kept = top_candidates(scored.withColumn("index", F.col("element.index")), "step", settings.candidates)
    lists = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("score", "element").alias("c"))), lambda a, b: a["rank"] - b["rank"]).alias("ranked"))
    lists = lists.select(*key, F.transform("ranked", lambda x: x["c"]).alias("candidates"))
    if answers is not None:
        lists = generate_plans(lists.withColumn("prompt", choice_prompt(or_empty(F.col("instruction")), or_empty(F.col("plan")), F.col("candidates"))), factory=strict_retry(answers), max_tokens=6).withColumnRenamed("output_text", "answer")
    else:
        lists = lists.withColumn("answer", F.lit(""))
    probe = F.col("probe") if answers is not None else None
    lists = lists.withColumn("probe", answer_probe("answer")) if answers is not None else lists
    element = choose_element(F.col("answer"), F.col("candidates"), probe)["element"]
    return lists.select("annotation_id", "step_index", F.struct(F.lit(None).cast("string").alias("backend_node_id"), element["attributes"].alias("attributes")).alias("selected"))


def evaluate(steps: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Step records, task metrics and corpus metrics of recorded outputs."""
    records = step_records(steps, outputs)
    return records, task_metrics(records, meta=("instruction", "website", "domain")), corpus_metrics(records)


def run_offline(steps: DataFrame, done: DataFrame, factory=stub_generator, settings: Settings = Settings(), answers=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompt, generate, ground and evaluate the tasks that aren't done yet.

    The history replays the ground truth's texts, so all steps of all tasks run in
    parallel; :func:`tracewright.operators.history.live_rollout` runs them in order.
    """
    todo = pending(steps, done, "annotation_id")
    seen = running_history(todo, "annotation_id", "step_index", "target_action_reprs")
    prompts = seen.select("annotation_id", "step_index", "cleaned_html", F.col("confirmed_task").alias("instruction"), step_prompt(F.col("confirmed_task"), F.col("history")).alias("prompt"))
    plans = generate_plans(prompts, factory=factory, max_tokens=settings.max_new_tokens, attempts=settings.attempts).withColumnRenamed("output_text", "plan")
    chosen = ground(plans.select("annotation_id", "step_index", "plan", "cleaned_html", "instruction"), settings, answers=answers)
    outputs = plans.select("annotation_id", "step_index", "plan", "latency", "error").join(chosen, ["annotation_id", "step_index"], "left")
    return evaluate(todo, outputs)


#: Methods of grounding by their number (fixed values): by attributes, by textual choice, by image.
METHODS = {"1": None, "2": ground, "3": None}


def grounding(method: str = "2"):
    """The function of a grounding method; ValueError for an unknown number.

    Methods without a definition to build raise NotImplementedError.
    """
    if method not in METHODS:
        raise ValueError(f"No grounding method {method!r}, only {', '.join(METHODS)}")
    if METHODS[method] is None:
        raise NotImplementedError(f"Grounding method {method} isn't defined")
    return METHODS[method]
