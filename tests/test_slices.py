"""Python UDFs hold slices of their batches, not whole ones."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracewright.functions import images
from tracewright.functions.html import dom_summary
from tracewright.functions.udf import batch_udf


@batch_udf("struct<rows:int,text:string>")
def seen(text: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"rows": [len(text)] * len(text), "text": text + n.astype(str)})


def test_batches_come_in_slices(spark):
    ids = spark.range(0, 3000, 1, 1)
    rows = ids.select("id", seen(F.when(F.col("id") % 7 > 0, F.col("id").cast("string")), "id").alias("s")).collect()
    assert [r["s"]["text"] for r in rows] == [f"{r['id']}{r['id']}" if r["id"] % 7 else None for r in rows]
    assert len(rows) == 3000 and max(r["s"]["rows"] for r in rows) <= 512
    long = ids.limit(20).select("id", seen(F.repeat(F.lit("x"), F.when(F.col("id") == 3, 400_000).otherwise(100_000)), "id").alias("s"))
    assert [(r["s"]["rows"], len(r["s"]["text"])) for r in long.orderBy("id").collect()][:6] == [(2, 100_001), (2, 100_001), (1, 100_001), (1, 400_001), (2, 100_001), (2, 100_001)]


def test_slices_of_pages(spark):
    pages = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("<p>a</p>"), (F.col("id") % 3).cast("int")).alias("html"))
    assert [r[0] for r in pages.select(F.size(dom_summary("html"))).collect()] == [i % 3 for i in range(600)]
    assert pages.where("id < 0").select(dom_summary("html")).collect() == []


def test_images_leave_in_parts(monkeypatch):
    monkeypatch.setattr(images, "HELD", 100)
    data = pd.Series([images.write_png(np.full((6, 6, 1), k, np.uint8)) for k in range(5)] + [None, b"JFIF"])
    parts = list(images._each(lambda x: ((i := images.decode(x)), i.ravel().astype(np.float32)), data))
    assert [len(p) for p in parts] == [3, 4]
    whole = pd.concat(parts)
    assert [None if p is None else p[0] for p in whole["pixels"]] == [0, 1, 2, 3, 4, None, None] and list(whole["error"])[5:] == ["no image", "unknown image format"]
    assert list(images._each(None, data[:0])) == []


def test_rows_of_one_filter_are_read_together():
    image = np.random.default_rng(3).integers(0, 256, (9, 5, 3), dtype=np.uint8)
    kinds = [2, 2, 2, 0, 0, 2, 2, 1, 1]
    lines = image.reshape(9, 15).astype(int)
    above, left = np.vstack([np.zeros((1, 15), int), lines[:-1]]), np.hstack([np.zeros((9, 3), int), lines[:, :-3]])
    data = np.array([[k, *((v - {0: 0 * v, 1: b, 2: a}[k]) % 256)] for k, v, a, b in zip(kinds, lines, above, left, strict=True)], np.uint8)
    assert (images._unfiltered(data.ravel(), 9, 15, 3) == lines).all()
