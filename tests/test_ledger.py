"""Calls that are billed: once each, whatever is run again."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import cost
from tracewright.models import Answer, billed_calls
from tracewright.sources import sinks


def test_reruns_bill_nothing_twice(spark, tmp_path):
    path, made = str(tmp_path / "ledger"), str(tmp_path / "made")
    rows = spark.createDataFrame([(t, i, f"p{t}{i}") for t in range(4) for i in range(5)] + [(0, 0, "p00"), (None, 7, None)], "annotation_id long, step_index long, prompt string")
    bad = {"p11", "p23"}

    def factory():
        import uuid
        from pathlib import Path

        Path(made).mkdir(exist_ok=True)

        def generate(prompt, image, tokens):
            Path(made, f"{prompt}-{uuid.uuid4()}").touch()
            if prompt in bad:
                return Answer("", 10, 0)  # answered, but with nothing
            return Answer(f"said {prompt}", 10, 2)

        return generate

    def run(df, batch, known=None):
        calls = billed_calls(df, "r", "gpt-4o-mini", ("annotation_id", "step_index"), factory, known=known, attempts=2, pause=0.0)
        sinks.write_ledger(calls, path, "r", batch)

    run(rows.where("annotation_id < 2 or annotation_id is null"), "a")
    run(rows.where("annotation_id < 2 or annotation_id is null"), "a")  # the same batch again
    run(rows.where("annotation_id in (1, 2)"), "b")  # and one that is cut differently
    held = sinks.ledger(spark, path, "r")
    assert held.count() == 16 and held.where("error is not null").count() == 2
    total = cost.totals(held).where("level = 0").first()
    assert (total.calls, total.prompt_tokens, total.completion_tokens) == (16, 16 * 10 + 2 * 10, 14 * 2)
    before = {f.name for f in (tmp_path / "made").iterdir()}
    known = spark.createDataFrame(held.select("call_id", "error").collect(), "call_id string, error string")
    bad.clear()
    run(rows, "c", known)  # only what was never answered
    new = sorted(f.name.split("-")[0] for f in (tmp_path / "made").iterdir() if f.name not in before)
    assert new == ["p11", "p23", *(f"p3{i}" for i in range(5))]
    after = sinks.ledger(spark, path, "r")
    assert after.count() == 21 and after.where("error is not null").count() == 0
    assert sinks.ledger(spark, path, "other").count() == 0


def test_calls_need_their_column_names(spark):
    df = spark.createDataFrame([(1, "x", "m")], "id int, prompt string, Model string")
    with pytest.raises(ValueError, match="Model"):
        billed_calls(df, "r", "m", ("id",), lambda: None)
    none = billed_calls(df.drop("Model").where(F.lit(False)), "r", "m", ("id",), lambda: None)
    assert none.count() == 0 and none.columns[-1] == "error"
