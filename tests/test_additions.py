"""Edges of parsing, page, cost and sink operators."""

import json
import logging
import time

import pytest
from pyspark.sql import functions as F

from tracewright import config
from tracewright.functions import cost, html, jsonfn
from tracewright.operators import checkpoint, decode, match, sampling
from tracewright.plans import derive, pipeline
from tracewright.sources import sinks, steps


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("", None),
        ("5", 5),
        ('Output: {"a": {"b": 1}} {"c": 2}', {"a": {"b": 1}}),  # the label's object ends at its first brace, which can't be read
        ('OUTPUT: {"a": 1} {"c": 2}', {"a": 1}),
        ('{"a": 1', None),
        ('x {"a": {"b": {"c": 1}}', {"b": {"c": 1}}),
        ('"action": "go", "target": {"x": y}, "value": "a\nb", "confidence": 1.2.3', {"action": "go", "target": None, "value": "a\nb"}),
        ('"value": null, "value": "late"', {"value": "late"}),
        ('"target": {"x": 1}, "confidence": 1', {"x": 1}),  # an object in the text comes before single fields
    ],
)
def test_labelled_answers(text, want):
    assert jsonfn.extract_labelled(text) == want


def test_actions_read_and_written(spark):
    df = spark.createDataFrame([(None,), ("[1]",), ("{",), ("{}",), ('{"action_type":null,"target":{"coords":[1,2]},"value":"a \\"b\\"","confidence":1}',)], "j string")
    got = [r[0] for r in df.select(decode.to_text(decode.from_text(F.col("j")))).collect()]
    assert got[:3] == [None] * 3
    assert json.loads(got[3]) == {"action_type": "noop", "target": None, "value": None, "confidence": 0.0}
    assert json.loads(got[4]) == {"action_type": None, "target": {"coords": [1.0, 2.0]}, "value": 'a "b"', "confidence": 1.0}


def test_round_trips_parse_once_a_pass(spark):
    df = spark.createDataFrame([('{"value":"v","confidence":null}',), ("[1]",)], "j string")
    twice = df.select(decode.to_text(decode.from_text(decode.to_text(decode.from_text(F.col("j"))))).alias("a"))
    plan = twice._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jsonObjectKeys(") == 2 and len(plan) < 20_000
    assert [r[0] and json.loads(r[0]) for r in twice.collect()] == [{"action_type": "noop", "target": None, "value": "v", "confidence": None}, None]


def test_long_pages_are_linear():
    began = time.perf_counter()
    found = html.interactive("<i>x</span>" * 20_000 + "<a>y</a>" * 5_000)
    assert len(found) == 5_000 and found[0]["text"] == "y"
    assert [e["text"] for e in html.interactive("<label>a<label>b")] == ["ab", "b"]
    assert len(html.summary("<p>x" * 20_000)) == 500
    assert time.perf_counter() - began < 20


def test_rows_by_position(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "k int")
    at = lambda n: [r[0] for r in sampling.row_at(df, ["k"], n).collect()]
    assert [at(n) for n in (0, 1, 2, 3, -1, -3, -4)] == [[None], [1], [3], [], [3], [None], []]
    assert sampling.row_count(df.where("false")).first()[0] == 0


def test_lists_of_ids(spark):
    done = spark.createDataFrame([("b",), ("a",), ("b",), ("",), (None,)], "k string")
    assert [r[0] for r in checkpoint.listed(done, "k").collect()] == ["a", "b"]
    assert checkpoint.counted(done, "k").first()[0] == 2


def test_cost_totals_keep_null_keys_apart(spark):
    calls = spark.createDataFrame([("a", 0, "gpt-4o", 1_000_000, None), ("a", None, None, 10, 1_000_000), (None, None, "gpt-4o", None, None)], "annotation_id string, step_index int, model string, prompt_tokens long, completion_tokens long")
    got = {(r["level"], r["annotation_id"], r["step_index"]): r for r in cost.totals(calls).collect()}
    assert len(got) == 6 and got[0, None, None]["calls"] == 3 and got[1, None, None]["calls"] == 1
    assert got[2, "a", 0]["cost_usd"] == 2.5 and got[1, "a", None]["cost_usd"] == pytest.approx(3.1000015)
    assert got[0, None, None]["total_tokens"] == 2_000_010


def test_sinks_replace_a_run(spark, tmp_path):
    out = str(tmp_path)
    totals = spark.createDataFrame([(0.12345678,)], "cost_usd double")
    for run in ("r1", "r1", "r2"):
        sinks.write_costs(totals, out, run)
    assert sorted((r["run_id"], r["cost_usd"]) for r in spark.read.json(f"{out}/costs").collect()) == [("r1", 0.123457), ("r2", 0.123457)]
    rows = spark.range(3)
    for run, batch in (("1", "a"), ("1", "a"), ("1", "b"), ("2", "a")):
        sinks.accumulate(rows, f"{out}/results", run, batch)
    assert [sinks.accumulated(spark, f"{out}/results", r).count() for r in ("1", "2", "3")] == [6, 3, 0]


def test_summary_and_run_folder(spark, tmp_path):
    pairs = match.action_flags(derive.action_pairs(spark, "/root/testdata/sf0.001")).limit(50).cache()
    said = []
    text = sinks.show_summary(pairs, 5.0, said.append)
    assert said == [text] and "Samples: 50" in text and "Time: 5.0 s (0.10 s a sample)" in text and " of 50)" in text
    sinks.write_run(pairs, pairs.limit(1), pairs.limit(1), str(tmp_path), "x", text)
    assert "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/run_x/report").collect()) == text
    assert sinks.report({"total": 0, "action_accuracy": 0.0, "target_accuracy": 0.0, "value_accuracy": 0.0}, [], 1.0).startswith("Samples: 0")


def test_images_below_a_root_with_odd_signs(spark, tmp_path):
    folder = tmp_path / "a+b(c)" / "d" / "a+b(c)"
    folder.mkdir(parents=True)
    (folder / "x.png").write_bytes(b"1")
    assert [tuple(r) for r in steps.read_images(spark, str(tmp_path / "a+b(c)")).collect()] == [("d/a+b(c)/x.png", bytearray(b"1"))]


def test_pages_without_anything(spark):
    df = spark.createDataFrame([(None, None), ("<p>x", ["{}", None, "bad"])], "cleaned_html string, pos_candidates array<string>")
    got = steps.with_page(df).collect()
    assert [len(r["dom_elements"]) for r in got] == [0, 1] and [len(r["candidates"]) for r in got] == [0, 3] and got[0]["ocr_tokens"] == []


def test_methods_settings_and_log(tmp_path):
    assert pipeline.grounding("2") is pipeline.ground
    with pytest.raises(ValueError):
        pipeline.grounding("4")
    with pytest.raises(NotImplementedError):
        pipeline.grounding("1")
    s = config.Settings.read({"USE_8BIT": "True", "ATTEMPTS": "2", "MATCH_PIXELS": "10", "MODEL_PATH": "/m", "IMAGE_DETAIL": "odd"})
    assert (s.use_8bit, s.attempts, s.match_pixels, s.model_path, s.image_detail, s.device) == (True, 2, 10.0, "/m", "auto", "auto")
    log = config.log_to(str(tmp_path / "log"), name="tracewright.test")
    assert config.log_to(str(tmp_path / "log"), name="tracewright.test").handlers == log.handlers and len(log.handlers) == 1
    log.info("hello")
    assert "INFO tracewright.test hello" in (tmp_path / "log").read_text()
    logging.shutdown()
