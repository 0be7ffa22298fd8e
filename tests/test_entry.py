"""The driver's contract, and the engine's queries against DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewright.models import stub_generator
from tracewright.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(float(r[i]), 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_whole_texts_are_read(spark, tmp_path):
    texts = ["word " * 100 + end for end in "abcdefgh"] + ["x " * 300 + "river", "river " + "y " * 300 + "river"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name, column: {r["doc_id"]: r[column] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    generate = stub_generator()
    assert run("vlm_infer_stub", "output_text") == {i: generate(t, None, 128) for i, t in enumerate(texts)}
    assert [run("text_overlap", "score")[i] for i in (8, 9)] == [1, 2]
