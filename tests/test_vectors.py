"""Nearest vectors in clusters against every pair, with small groups so that all of them are cut."""

import numpy as np
import pytest

from tracewright.operators import ranking, vectors


def near(df, queries, k):
    return {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.nearest_in_clusters(df, queries, k).collect()}


def brute(rows, asked, k):
    out = {}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q, a in asked:
        scored = []
        for i, b in rows:
            if i != q and len(a) == len(b):
                dot = 0.0
                for x, y in zip(a, b, strict=True):
                    dot += x * y
                scored.append((-dot / (norm(a) * norm(b)), i))
        out |= {(q, n): i for n, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("pivots", [1, 7, 64])
def test_equal_to_all_pairs(spark, monkeypatch, pivots):
    for name, value in (("PIVOTS", pivots), ("ROWS", 40), ("QUERIES", 3), ("CELLS", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 420)]  # a third are copies: ties
    rows += [(i, [float(i % 3), 1.0]) for i in range(420, 440)]  # another length
    rows += [(440, [-1.0] * 8), (441, [5.0])]
    odd = [(None, [1.0] * 8), (500, None), (501, []), (502, [0.0] * 8), (503, [None] + [1.0] * 7), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (506, [1e200] * 8)]
    again = rows[:5] + rows[300:305]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd + again], "vec_id long, embedding array<double>, id string").repartition(5)
    asked = [r for r in rows if r[0] % 10 == 0 or r[0] > 438]
    queries = spark.createDataFrame(asked + odd + again[:2], "vec_id long, embedding array<double>")
    assert near(df, queries, 4) == brute(rows, [*asked, *again[:2]], 4)


def test_as_the_pass_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS", 16)
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    want = {(r["query_id"], r["rank"]): r["vec_id"] for r in ranking.nearest_vectors(e, asked, 5).collect()}
    assert want and near(e, asked, 5) == want


def test_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert near(none, one, 3) == near(one, none, 3) == near(one, one, 3) == {}


def test_driver_reads_no_queries_and_clusters_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.01 * rng.normal(size=16)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []
    monkeypatch.setattr(vectors, "_meet", lambda placed, asked, blocks, k, meet=vectors._meet: met.append((placed, asked)) or meet(placed, asked, blocks, k))
    assert len(near(df, df.where("vec_id % 10 = 0"), 3)) == 240
    pairs = [placed.groupBy("cluster").count().join(asked.groupBy("cluster").count().withColumnRenamed("count", "n"), "cluster").selectExpr("sum(count * n)").first()[0] or 0 for placed, asked in met]
    assert sum(pairs) < 80 * 800 / 4
