"""Batches of similar lengths: the same results in the rows' order, less padding, failing batches taken apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import models


@pytest.mark.parametrize(("batch", "cells"), [(1, None), (4, None), (128, None), (4, 30), (128, 1)])
def test_batches_hold_every_row_once(batch, cells):
    lengths = np.array([5, 0, 9, 9, 100, 3, 3, 0, 12])
    got = list(models.batches_by_length(lengths, batch, cells))
    assert sorted(np.concatenate(got)) == list(range(9)) and all(0 < len(b) <= batch for b in got)
    assert list(lengths[np.concatenate(got)]) == sorted(lengths)
    if cells:
        assert all(len(b) == 1 or len(b) * lengths[b].max() <= cells for b in got)
    assert list(models.batches_by_length(np.array([], int), batch, cells)) == []


def rows(spark):
    texts = [None, ""] + ["w" * (1 + 37 * i % 200) + f" {i}" for i in range(300)]
    return spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)


def test_scores_are_equal_and_padding_is_less(spark):
    df = rows(spark).withColumn("a", F.concat(F.lit("w "), F.col("n")))
    scored = {b: models.score_pairs(df, "a", "t", batch=b, padded_to=True) for b in (1, 16)}
    plain = {r["n"]: r["score"] for r in models.score_pairs(df, "a", "t", batch=1).collect()}
    for df in scored.values():
        assert {r["n"]: r["score"] for r in df.collect()} == plain
    size = F.length(F.coalesce("t", F.lit(""))) + F.length("a")
    alone, sorted_ = (models.padding(scored[b], size).first() for b in (1, 16))
    assert alone["padding_share"] == 0 and alone["used"] == alone["padded"] == sorted_["used"]
    assert 0 < sorted_["padding_share"] < 0.2
    assert models.padding(scored[1].where("false"), size).first()["padding_share"] == 0


def test_batched_answers_are_those_of_single_calls(spark):
    df = rows(spark).withColumnRenamed("t", "prompt")
    want = {r["n"]: r["output_text"] for r in models.generate_plans(df).collect()}
    got = models.generate_batches(df, batch=7, cells=900).collect()
    assert {r["n"]: r["output_text"] for r in got} == want and all(r["error"] is None for r in got)


def test_batches_that_fail_are_taken_apart(spark):
    def factory():
        def generate(prompts, images, tokens):
            if len(prompts) * max(map(len, prompts)) > 400 and tokens > 64:
                raise models.OutOfMemory("too large")
            if len(prompts) > 1 and any("13" in p for p in prompts):
                raise ValueError("bad batch")
            if any(p.endswith(" 77") for p in prompts):
                raise ValueError("never")
            return ["" if len(prompts) > 1 and p.endswith(" 5") else f"{p}!" for p in prompts][: len(prompts) - (len(prompts) == 3)]

        return generate

    df = rows(spark).withColumnRenamed("t", "prompt")
    got = models.generate_batches(df, factory=factory, batch=8, attempts=2, pause=0.0).collect()
    assert len(got) == 302
    for r in got:
        bad = (r["prompt"] or "").endswith(" 77")
        assert (r["output_text"], r["error"]) == (("", "never") if bad else (f"{r['prompt'] or ''}!", None))
