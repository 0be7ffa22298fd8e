"""Operators over small tables: aggregates, history, checkpoint, sources, streams."""

import glob

import pytest
from pyspark.sql import functions as F

from tracewright.models import OutOfMemory, call, generate_plans
from tracewright.operators import checkpoint, history, match, metrics, ranking, sampling
from tracewright.plans import pipeline, queries
from tracewright.sources import sinks, steps
from tracewright.streaming import progress


@pytest.fixture(scope="module")
def records(spark):
    # Tasks: a fails one of one, b fails two of three, c passes all.
    rows = [("a", 0, False), ("b", 0, True), ("b", 1, False), ("b", 2, False), ("c", 0, True), ("c", 1, True)]
    df = spark.createDataFrame(rows, "annotation_id string, step_index int, ok boolean")
    return df.select("*", *(F.col("ok").alias(f) for f in metrics.STEP_FLAGS.values()), F.concat("annotation_id", F.col("step_index").cast("string")).alias("instruction"))


def test_task_and_corpus_metrics(records):
    got = {r["annotation_id"]: r for r in metrics.task_metrics(records, meta=("instruction",)).collect()}
    assert [(got[k]["offline0"], got[k]["offline1"]) for k in "abc"] == [(False, True), (False, False), (True, True)]
    assert got["b"]["step_success_rate"] == pytest.approx(1 / 3) and got["b"]["instruction"] == "b0"
    c = metrics.corpus_metrics(records).first()
    assert (c["total_steps"], c["total_tasks"], c["step_success_rate"]) == (6, 3, 0.5)
    assert c["offline0_rate"] == pytest.approx(1 / 3) and c["offline1_rate"] == pytest.approx(2 / 3)
    nothing = metrics.corpus_metrics(records.where("false")).first()
    assert nothing["total_steps"] == 0 and nothing["step_success_rate"] == 0.0


def test_empty_accuracy_and_all_succeeded(spark, records):
    flags = records.select(*(F.col("ok").alias(f) for f in metrics.ACTION_FLAGS))
    assert metrics.action_accuracy(flags.where("false")).first()["action_accuracy"] == 0.0
    assert records.where("false").select(metrics.all_succeeded(F.col("ok"))).first()[0] is True
    assert metrics.failures(flags, "no such flag").count() == 3
    assert [len(r["steps"]) for r in metrics.nested_steps(records).orderBy("annotation_id").collect()] == [1, 3, 2]


def test_noop_fill(spark):
    t = "struct<action_type:string,target:struct<selector:string,bbox:array<double>,coords:array<double>,text:string>,value:string>"
    oracle = spark.createDataFrame([(1, ("noop", None, None)), (2, ("click", None, None))], f"k int, oracle {t}")
    predictions = spark.createDataFrame([(2, ("click", None, None))], f"k int, predicted {t}")
    got = match.action_flags(metrics.with_noop_fill(oracle, predictions, "k")).orderBy("k").collect()
    assert [r["overall_match"] for r in got] == [True, True]


def test_history_and_rollout(spark):
    df = spark.createDataFrame([("a", 0, "p0"), ("a", 1, None), ("a", 2, "p2"), ("b", 0, "q")], "t string, i int, p string")
    got = {(r["t"], r["i"]): r["history"] for r in history.running_history(df, "t", "i", "p").collect()}
    assert got["a", 2] == ["None", "p0"] and got["b", 0] == ["None"]

    def generate(text, seen):
        if len(seen) == 2:
            raise ValueError("no")
        return f"{text}{len(seen)}"

    live = {(r["t"], r["i"]): (r["plan"], r["error"]) for r in history.live_rollout(df, "t", "i", "t", generate).collect()}
    assert live["a", 0] == ("a1", None) and live["a", 1] == (None, "no") and live["a", 2] == (None, "no")


def test_top_k_plan_has_group_limit(spark):
    df = spark.createDataFrame([("g", float(i % 3), i) for i in range(9)], "g string, score double, index int")
    top = ranking.top_candidates(df, "g", 2)
    assert [(r["index"], r["rank"]) for r in top.orderBy("rank").collect()] == [(2, 0), (5, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors_of_every_hundredth_row(spark, tmp_path, monkeypatch):
    vectors = {i: [1.0, float(i % 7), float(i * i % 11)] for i in range(350)} | {400: [0.0, 0.0, 0.0], 401: None, 402: [1.0]}
    spark.createDataFrame([(i, v, i % 5) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")

    def similarity(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 12)

    monkeypatch.setattr(ranking, "BLOCK", 3)
    got = queries.QUERIES["cosine_rank"](spark, str(tmp_path)).collect()
    for q in (0, 100, 200, 300):
        want = sorted((i for i in range(350) if i != q), key=lambda i: (-similarity(vectors[q], vectors[i]), i))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert len(got) == 20


def test_checkpoint(spark, tmp_path):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "annotation_id string")
    done = spark.createDataFrame([("b",), ("b",), (None,), ("",)], "annotation_id string")
    assert sorted(r[0] for r in checkpoint.pending(tasks, done, "annotation_id").collect()) == ["a", "c"]
    assert checkpoint.pending(tasks, done, "annotation_id", force=True).count() == 3
    assert [r["latency"] for r in checkpoint.skipped(tasks, done, "annotation_id").collect()] == [0.0]
    assert checkpoint.add(done, tasks, "annotation_id").count() == 3
    path = str(tmp_path / "done")
    sinks.append_checkpoint(done, path)
    sinks.append_checkpoint(tasks, path)
    assert sorted(r[0] for r in steps.read_checkpoint(spark, path).collect()) == ["a", "b", "c"]
    (tmp_path / "old.json").write_text('["x", "", null, "x"]')
    (tmp_path / "bad.json").write_text("{")
    assert [r[0] for r in steps.read_checkpoint(spark, str(tmp_path / "old.json")).collect()] == ["x"]
    assert steps.read_checkpoint(spark, str(tmp_path / "bad.json")).count() == 0
    assert steps.read_checkpoint(spark, str(tmp_path / "none")).count() == 0


def test_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = (sorted(r[0] for r in sampling.sample_n(df.repartition(n), "k", 7).collect()) for n in (1, 5))
    assert a == b and len(a) == 7 and sampling.sample_n(df, "k", 99).count() == 50
    assert sampling.sample_fraction(df, "k", 0.1).count() == 5
    with pytest.raises(KeyError):
        sampling.task(df, "k", 77)


STEP = '{"op": "CLICK"}'


@pytest.fixture
def trace(spark, tmp_path):
    rows = [("t1", 0, "<a backend_node_id='5'>buy</a><p>x</p>", STEP, ['{"backend_node_id":"5"}'], "Task", "a buy"), ("t1", 1, "<button backend_node_id='6'>pay</button>", '{"op":"TYPE","value":"v"}', [], "Task", "b pay"), ("t2", 0, "", STEP, None, None, None)]
    df = spark.createDataFrame(rows, "annotation_id string, step_index int, cleaned_html string, operation string, pos_candidates array<string>, confirmed_task string, target_action_reprs string")
    df.write.parquet(str(tmp_path / "data" / "train-0.parquet"))
    return str(tmp_path)


def test_read_and_run(spark, trace, tmp_path):
    table = steps.read_split(spark, trace)
    assert table.count() == 3 and table.where("website is not null").isEmpty()
    assert steps.read_file(spark, trace, "train-0.parquet").count() == 3
    assert steps.read_file(spark, trace, "other.parquet", fallback=table).count() == 3
    done = spark.createDataFrame([("t2",)], "annotation_id string")
    records, tasks, corpus = pipeline.run_offline(table, done)
    records = records.cache()
    assert {r["annotation_id"] for r in records.collect()} == {"t1"} and corpus.first()["total_steps"] == 2
    assert {r["predicted_id"] for r in records.collect()} == {"5", "6"}
    out = str(tmp_path / "out")
    sinks.write_steps(records, out, "r1")
    sinks.write_tasks(tasks, metrics.nested_steps(records, columns=("step_success",)), out, "r1")
    sinks.write_aggregate(corpus, out, "r1")
    assert spark.read.json(f"{out}/task_results").first()["total_steps"] == 2
    assert "PushedFilters: [IsNotNull(annotation_id), EqualTo(annotation_id,t1)]" in table.where("annotation_id = 't1'")._jdf.queryExecution().executedPlan().toString()


def test_ground_reads_answers_of_every_kind(spark):
    page = "<a backend_node_id='5'>buy</a><button backend_node_id='6'>pay now</button>"
    plans = spark.createDataFrame([(t, 0, "click buy", page, t) for t in ("text", "index", "none")], "annotation_id string, step_index int, plan string, cleaned_html string, instruction string")

    def answers():
        def generate(prompt, image, tokens):
            if "0. <a>" not in prompt or "1. <button>" not in prompt:
                return "0"
            if "instruction: index" in prompt:
                return "1"
            if "single token: an integer" not in prompt:
                return "hm"
            return 'Selected element: {"text": "pay now"}' if tokens == 4 and "instruction: text" in prompt else "hm"

        return generate

    got = {r["annotation_id"]: r["selected"]["attributes"]["backend_node_id"] for r in pipeline.ground(plans, answers=answers).collect()}
    assert got == {"text": "6", "index": "6", "none": "5"}


def test_report():
    text = sinks.report({"total": 2, "action_accuracy": 0.5, "target_accuracy": 1.0, "value_accuracy": 1.0}, [{"oracle_action_type": "click", "total": 2, "action_match_rate": 0.5}])
    assert "Action accuracy: 50.00%" in text and "click (n=2)" in text


def test_calls(spark):
    seen = []

    def heavy(prompt, image, tokens):
        seen.append(tokens)
        if tokens > 64:
            raise OutOfMemory("big")
        return "ok"

    assert call(heavy, "p", None, 128, 4, lambda s: None) == ("ok", None) and seen == [128, 64]
    waits = []
    assert call(lambda *a: "", "p", None, 8, 4, waits.append) == ("", "empty answer") and waits == [2, 4, 6]
    df = spark.createDataFrame([("a",), (None,)], "prompt string")
    assert [bool(r["output_text"]) for r in generate_plans(df).collect()] == [True, True]


def test_streaming(spark, records, tmp_path):
    source = str(tmp_path / "in")
    rows = records.withColumn("action_uid", F.concat("annotation_id", F.col("step_index").cast("string")))
    rows.write.parquet(source)
    rows.write.mode("append").parquet(source)  # every record twice
    stream = spark.readStream.schema(rows.schema).parquet(source)
    progress.drain_to_table(progress.running_task_metrics(stream), "running", str(tmp_path / "ck"), "complete").awaitTermination(120)
    got = {r["annotation_id"]: r["total_steps"] for r in spark.table("running").collect()}
    assert got == {"a": 1, "b": 3, "c": 2} and glob.glob(f"{source}/*.parquet")
