"""Bootstrap intervals, mergeable states and the stateful rollout, each against a plain version."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import metrics, state, uncertainty
from tracewright.operators.history import live_rollout
from tracewright.streaming.rollout import rollout_stream


def test_weights_are_poisson():
    counts, at = [0] * 12, uncertainty.thresholds()
    for k in range(20_000):
        counts[sum(int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) >= t for t in at)] += 1
    for k in range(4):
        assert abs(counts[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.012


def test_intervals_equal_a_plain_loop(spark):
    rows = [(t and f"t{t}", ((t or 0) * 7 + s) % 3 == 0) for t in (*range(1, 40), None) for s in range(1 + (t or 0) % 5)]
    df = spark.createDataFrame(rows, "task string, ok boolean").repartition(5)
    got = uncertainty.intervals(df, "task", {"rate": (F.count_if("ok"), F.count(F.lit(1)))}, n=30, seed=1).collect()
    at, drawn = uncertainty.thresholds(), []
    for r in range(30):
        part = whole = 0
        for t, ok in rows:
            digits = hashlib.md5(f"{t or ''}|1|{r // 4}".encode()).hexdigest()[8 * (r % 4) : 8 * (r % 4) + 8]
            w = sum(int(digits, 16) >= x for x in at)
            part, whole = part + w * ok, whole + w
        drawn.append(part / whole)
    drawn.sort()
    assert [tuple(r) for r in got] == [("rate", sum(ok for _, ok in rows) / len(rows), drawn[0], drawn[29])]
    assert [tuple(r) for r in uncertainty.intervals(df.where("false"), "task", {"rate": (F.count_if("ok"), F.count(F.lit(1)))}).collect()] == [("rate", 0.0, None, None)]


def test_failures_know_both_evaluators(spark):
    steps = spark.createDataFrame([(1, True, False), (2, False, None), (3, True, True)], "i int, element_match boolean, step_success boolean")
    ids = lambda flag: sorted(r.i for r in metrics.failures(steps, flag).collect())
    assert (ids("element_match"), ids("step_success"), ids("never")) == ([2], [1, 2], [1, 2])


def test_states_of_batches_merge(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2 == 0).alias("ok"), F.when(F.col("id") % 3 < 2, (F.col("id") * 7919 % 5000).cast("double")).alias("t"), (F.col("id") % 11).alias("b"))
    for b in (*range(11), 4):  # one batch twice
        state.add_batch(state.state(df.where(F.col("b") == b), ["g"], ("ok",), "t"), str(tmp_path / "s"), "r1", str(b))
    state.add_batch(state.state(df, ["g"], ("ok",), "t"), str(tmp_path / "s"), "other", "0")
    states = state.states_of(spark, str(tmp_path / "s"), "r1")
    assert states.count() == 33
    got = {r.g: r for r in state.rates(state.merged(states, ["g"]), (0.1, 0.5)).collect()}
    exact = {r.g: r for r in df.groupBy("g").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("ok"), F.avg("t").alias("mean")).collect()}
    for g, r in got.items():
        assert (r.total, r.ok_rate) == (exact[g].n, exact[g].ok)
        if g < 2:
            assert r.mean_time == pytest.approx(exact[g].mean) and abs(r.time_10 - 500) < 150 and abs(r.time_50 - 2500) < 150
        else:
            assert (r.mean_time, r.time_50) == (None, None)
    assert state.merged(states.where("false"), ["g"]).count() == 0


def test_stateful_rollout_equals_the_whole_table(spark, tmp_path):
    def say(text, history):
        if text == "boom":
            raise ValueError("no plan")
        return f"{text}<{'|'.join(history)}"

    rows = [(t, i, "boom" if (t + i) % 7 == 3 else f"s{t}{i}") for t in range(5) for i in range(9)]
    kind = "task long, i long, text string"

    def drain():
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        out = rollout_stream(stream, "task", "i", "text", say)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 4), (4, 5), (5, 9)):  # each a run of its own that goes on from the checkpoint
        spark.createDataFrame([r for r in rows if low <= r[1] < high], kind).write.mode("append").parquet(str(tmp_path / "in"))
        drain()
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("task", "i", "plan", "error").collect() if r.error != "out of order")
    want = sorted(tuple(r) for r in live_rollout(spark.createDataFrame(rows, kind), "task", "i", "text", say).select("task", "i", "plan", "error").collect())
    assert [r[:3] for r in read()] == [r[:3] for r in want] and [r[3] is None for r in read()] == [r[3] is None for r in want]
    spark.createDataFrame([(0, 2, "again"), (0, 9, "next"), (7, None, "x")], kind).write.mode("append").parquet(str(tmp_path / "in"))
    drain()
    new = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("(task = 0 and (i = 9 or error = 'out of order')) or task = 7").select("task", "i", "plan", "error").collect()]
    last = next(p for t, i, p, _ in reversed(want) if t == 0 and p)
    assert {(0, 2, None, "out of order"), (7, None, None, "no order")} < set(new) and len(new) == 3
    assert next(p for t, i, p, _ in new if (t, i) == (0, 9)).endswith(f"|{last}")
