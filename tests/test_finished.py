"""A checkpoint that grows: appends, merges that die or race, and the bitmap before the anti-join."""

import pytest

from tracewright.operators import checkpoint
from tracewright.sources import finished


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "annotation_id string")


def held(spark, path):
    return sorted(r[0] for r in finished.finished(spark, path).collect())


def test_appends_and_merges(spark, tmp_path):
    path = str(tmp_path / "done")
    assert held(spark, path) == [] and not finished.merge(spark, path)
    finished.append(ids(spark, "a", "b", None, ""), path)
    finished.append(ids(spark, "b", "c"), path)
    assert held(spark, path) == ["a", "b", "c"]
    assert finished.merge(spark, path, files=2) and not finished.merge(spark, path)
    finished.append(ids(spark, "d", "a"), path)
    assert held(spark, path) == ["a", "b", "c", "d"]
    assert finished.merge(spark, path) and held(spark, path) == ["a", "b", "c", "d"]
    assert finished.clean(spark, path) > 1 and held(spark, path) == ["a", "b", "c", "d"]
    assert finished.clean(spark, path) == 0
    finished.append(ids(spark, "e"), path)
    assert finished.merge(spark, path) and held(spark, path) == ["a", "b", "c", "d", "e"]


def test_a_merge_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "done")
    for name in ("a", "b"):
        finished.append(ids(spark, name), path)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(finished, "_publish", die)
        with pytest.raises(RuntimeError):
            finished.merge(spark, path)
    assert held(spark, path) == ["a", "b"]
    assert finished.merge(spark, path) and held(spark, path) == ["a", "b"]
    finished.clean(spark, path)  # takes the dead merge's folder along
    assert len(finished._children(spark, f"{path}/merged")) == 1 and held(spark, path) == ["a", "b"]


def test_merges_at_once_and_an_append_between(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "done")
    finished.append(ids(spark, "a"), path)
    publish = finished._publish

    def late(*args):  # another append, and another merge that publishes first
        monkeypatch.setattr(finished, "_publish", publish)
        finished.append(ids(spark, "b"), path)
        finished.merge(spark, path)
        finished.append(ids(spark, "c"), path)
        publish(*args)

    monkeypatch.setattr(finished, "_publish", late)
    finished.merge(spark, path)
    assert held(spark, path) == ["a", "b", "c"]
    finished.merge(spark, path)
    assert held(spark, path) == ["a", "b", "c"]


@pytest.mark.parametrize("bits", [None, 64, 100_003])
def test_bitmap_agrees_with_the_anti_join(spark, bits):
    tasks = spark.createDataFrame([(f"t{i % 700}" if i else None, i) for i in range(1_000)], "`k` string, `__done` int")
    tasks = tasks.withColumnRenamed("__done", "n")
    done = spark.createDataFrame([(f"t{i}",) for i in range(0, 900, 3)] + [(None,), ("",), ("t0",)], "k string")
    want = sorted(r["n"] for r in checkpoint.pending(tasks, done, "k").collect())
    got = checkpoint.pending_by_bitmap(tasks, done, "k", bits)
    assert got.columns == tasks.columns and sorted(r["n"] for r in got.collect()) == want
    none = done.where("false")
    assert checkpoint.pending_by_bitmap(tasks, none, "k").count() == 1_000 and checkpoint.pending_by_bitmap(tasks.where("false"), done, "k").count() == 0


def test_few_rows_reach_the_anti_join(spark, tmp_path):
    path = str(tmp_path / "done")
    finished.append(spark.range(2_000).selectExpr("cast(id as string) annotation_id"), path)
    tasks = spark.range(20_000).selectExpr("cast(id as string) k")
    out = finished.pending(spark, tasks, path, "k")
    assert out.count() == 18_000
    done = finished.finished(spark, path).withColumnRenamed("annotation_id", "k")
    surely, maybe = checkpoint._parted(tasks, done, "k", 2_000 * checkpoint.BITS_EACH)
    assert surely.count() + maybe.count() == 20_000
    assert 2_000 <= maybe.count() < 2_000 + 18_000 / 10  # the finished ones and about a sixteenth of the others
