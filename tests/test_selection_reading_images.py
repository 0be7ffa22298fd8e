"""Selection without a sort of all rows, built-in readings of JSON, and image decoding."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import images, jsonfn
from tracewright.operators import sampling

# Selection


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(sampling, "SMALL", 40)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 40, 41, 700, 999, 1000, 2000])
def test_large_samples_are_the_rows_of_the_top_n(spark, small, n):
    df = spark.range(1000).withColumn("k0", F.col("id") % 7).repartition(5)
    want = {r["id"] for r in df.orderBy(sampling.hash_order("id", 42), "id").limit(n).collect()}
    got = sampling.sample_n(df, "id", n)
    rows = got.collect()
    assert {r["id"] for r in rows} == want and len(rows) == min(n, 1000)
    if 40 < n <= 1000:
        assert "Limit" not in plan(got) and "TakeOrdered" not in plan(got)


@pytest.mark.parametrize("n", [60, 150, 299])
def test_ties_fill_a_sample_exactly(spark, small, n):
    df = spark.range(300).select((F.col("id") % 4).alias("key"), "id")
    got = [r["key"] for r in sampling.sample_n(df, "key", n).collect()]
    want = [r["key"] for r in df.orderBy(sampling.hash_order("key", 42), "key").limit(n).collect()]
    assert sorted(got) == sorted(want)


def test_null_keys_and_empty_tables(spark, small):
    df = spark.range(200).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("key"))
    got = [r["key"] for r in sampling.sample_n(df, "key", 100).collect()]
    want = [r["key"] for r in df.orderBy(sampling.hash_order("key", 42), "key").limit(100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sampling.sample_n(df.where("false"), "key", 100).count() == 0
    assert sampling.row_at(df.where("false"), ["key"], 90).count() == 0


@pytest.mark.parametrize("position", [0, 39, 40, 123, 599, 600, -1, -40, -41, -600, -601])
def test_rows_far_inside(spark, small, position):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "é", "z"]), rng.choice([None, float("nan"), 1.5, -2.0]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, x double, i long").repartition(4)
    ordered = [r["i"] for r in df.orderBy("s", "x", "i").collect()]
    got = [r["i"] for r in sampling.row_at(df, ["s", "x", "i"], position).collect()]
    assert got == (ordered[position : position + 1] if position >= 0 else ordered[len(ordered) + position :][:1] if -position <= 600 else [])


# Readings of JSON

TEXTS = [
    None, "", " ", "{}", " {} ", "5", "[1]", '"x"', "null", "{", "}", "} {", '{"a":1} x', 'x {"a":1}', '{"a":"}"}', '{"a":"{"}', '{"a":"{"} }', '[{"action":1}]', '"{}" {"a":1}',
    '{"action_type":"click"}', '{"action":"type","value":"x"}', '{"action":{"b":[1,null]}}', '{"action":null}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1,}', '{"a":[1,],}', "{'a': 'it'}", "{'a': \"b\",}",
    '```json\n{"a":1}\n```', "```\n{'a':1}\n```", '```json {"a":"```"}', '{"a":1}{"b":2}', '{"a":1},{"b":2}', 'x {"a":{"b":{}}} {"c"', " {\"a\":\"é😀\\u00e9\"} ", '{"a":"\n"}', '{"a":1} // no', '{"value":"a\\"}b"}',
    '{"confidence": 0.25, "action_type": "x" ', "action: {'action_type': 'click', 'confidence': 2}", '{"a":01}', "{a:1}", '{"a":1e5,"b":-0.0,"c":12345678901234567890123}', '{"a":tru}', '{"":1}', '{"a":"\\ud800"}',
]


def mutated(n, seed=0):
    rng, out = random.Random(seed), []
    for _ in range(n):
        value = {rng.choice(["action", "action_type", "value", "target", "x"]): rng.choice([None, "a", "it's", "{", "}", 0.5, 3, True, {"selector": "#a"}, [1, {"b": "c,}"}]]) for _ in range(rng.randrange(4))}
        text = json.dumps(value)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text = rng.choice([text[:at] + rng.choice('{}[],"\' x') + text[at:], text[:at] + text[at + 1 :], text.replace('"', "'"), "So: " + text, text + " done", text[:-1] + ",}", f"```json\n{text}\n```", text + text])
        out.append(text)
    return out


@pytest.mark.parametrize("which", ["repair", "parse"])
def test_built_in_readings_equal_the_cascade(spark, which):
    texts = TEXTS + mutated(600)
    column, plain = {"repair": (jsonfn.repair_json, jsonfn.repair_action), "parse": (jsonfn.parse_json, lambda t: ((lambda v, e: (None if v is None else json.dumps(v), e))(*jsonfn.parse_loose(t))))}[which]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["j"], r["e"]) for r in column(df, "t", "p").select("i", F.col("p.json").alias("j"), F.col("p.error").alias("e")).collect()}
    for i, t in enumerate(texts):
        want_json, want_error = plain(t)
        read = lambda j: None if j is None else json.loads(j, parse_float=float)
        assert got[i][1] == want_error, t
        assert repr(read(got[i][0])) == repr(read(want_json)) or read(got[i][0]) == read(want_json), t


def test_only_broken_texts_go_to_python(spark):
    texts = ['{"a":1}', 'So: {"a":1}.', "{'a':1,}", '```json\n{"a":1}\n```', "no action", '{"a":NaN}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] is not None for r in df.select(jsonfn.read_object(F.col("t"))).collect()] == [True, True, False, True, False, False]


def test_balanced_fold(spark):
    texts = [t for t in TEXTS + mutated(200, 1) if t is not None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jsonfn.balanced(F.col("t"))).collect()]
    for t, g in zip(texts, got, strict=True):
        depth, want = 0, None
        for i, c in enumerate(t[max(t.find("{"), 0) :] if "{" in t else ""):
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                want = t[t.find("{") :][: i + 1]
                break
        assert g == want, t


# Images


def picture(seed, h, w, c):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def png(image, kinds, colour, palette=b""):
    """Written plainly, with the given row filters in turn."""
    h, w, c = image.shape
    lines, above = b"", [0] * (w * c)
    for y in range(h):
        row, kind = image[y].ravel().tolist(), kinds[y % len(kinds)]
        line = []
        for i, v in enumerate(row):
            a, b, d = (row[i - c] if i >= c else 0), above[i], (above[i - c] if i >= c else 0)
            p = a + b - d
            near = sorted([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)])[0][2]
            line.append((v - [0, a, b, (a + b) // 2, near][kind]) % 256)
        lines += bytes([kind, *line])
        above = row
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    packed = zlib.compress(lines)
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("channels", "colour"), [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_png_with_every_filter(channels, colour):
    image = picture(1, 11, 7, channels)
    got = images.decode(png(image, [0, 1, 2, 3, 4, 4, 3, 1], colour))
    assert (got == image[..., : 3 if channels > 2 else 1]).all()


def test_palettes_netpbm_and_bmp():
    index, colours = picture(2, 5, 4, 1) % 3, picture(3, 3, 3, 1)[..., 0]
    assert (images.decode(png(index, [0, 4], 3, colours.tobytes())) == colours[index[..., 0]]).all()
    rgb = picture(4, 3, 5, 3)
    assert (images.decode(b"P6\n# note\n5 3\n255\n" + rgb.tobytes()) == rgb).all()
    line = lambda y: rgb[y, :, ::-1].tobytes() + b"\0"
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (images.decode(head + b"".join(map(line, (2, 1, 0)))) == rgb).all()
    assert (images.decode(images.write_png(rgb)) == rgb).all()


@pytest.mark.parametrize(("size", "target"), [((8, 12), (4, 3)), ((7, 10), (3, 4)), ((3, 2), (7, 5)), ((6, 9), (9, 4)), ((1, 1), (3, 3)), ((5, 5), (5, 5))])
def test_resampling_by_plain_loops(size, target):
    image = picture(5, *size, 3)

    def line(values, n):
        m = len(values)
        if n == m:
            return values
        if n < m:  # by area
            return [sum(v * max(0, min((i + 1) * m / n, j + 1) - max(i * m / n, j)) for j, v in enumerate(values)) * n / m for i in range(n)]
        at = [min(max((i + 0.5) * m / n - 0.5, 0), m - 1) for i in range(n)]
        return [values[int(x)] * (1 - x % 1) + values[min(int(x) + 1, m - 1)] * (x % 1) for x in at]

    got = images.resample(image, target[1], target[0])
    for c in range(3):
        columns = [line(image[:, x, c].astype(float).tolist(), target[0]) for x in range(size[1])]
        want = np.array([line([columns[x][y] for x in range(size[1])], target[1]) for y in range(target[0])])
        assert np.abs(got[..., c] - want).max() <= 0.5 + 1e-6


def test_prepared_columns_and_broken_bytes(spark):
    image = picture(6, 6, 8, 1)
    good = images.write_png(image)
    rows = [(0, good, 4), (1, good[:40], 4), (2, None, 4), (3, b"", 4), (4, b"JFIF", 4), (5, good, None), (6, good[:-30], 4), (7, b"P5 1 1 255\n\x07", 2), (8, b"P5 9999999 999999 255\n", 2), (9, b"P5 x", 2), (10, good, 0)]
    df = spark.createDataFrame(rows, "i int, b binary, w int")
    got = {r["i"]: r["p"] for r in df.select("i", images.prepared(F.col("b"), F.col("w"), F.lit(6)).alias("p")).collect()}
    assert {i for i, p in got.items() if p["error"] is None} == {0, 7}
    assert (got[0]["width"], got[0]["height"], got[0]["channels"], len(got[0]["pixels"])) == (4, 6, 3, 72)
    inner = images.resample(image, 4, 3)
    want = np.zeros((6, 4, 3), np.float32)
    want[1:4] = inner.astype(np.float32) / np.float32(255)
    assert np.allclose(np.array(got[0]["pixels"]).reshape(6, 4, 3), want)
    flat = df.where("i = 0").select(images.decoded(F.col("b")).alias("p")).first()["p"]
    assert flat["pixels"] == image.ravel().tolist() and flat["error"] is None
    read = df.where("i = 4").select(images.decoded(F.col("b"), reader=lambda b: np.full((2, 3), len(b), np.uint8)).alias("p")).first()["p"]
    assert (read["width"], read["height"], read["pixels"]) == (3, 2, [4.0] * 6)
