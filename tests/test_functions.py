"""Golden cases and truth tables of the built-in expressions."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import cost, geometry, jsonfn, text
from tracewright.functions.html import interactive, summary
from tracewright.operators import decode, match, ranking


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("plan", "kind", "value"),
    [
        ("click: Click on X", "CLICK", ""),
        ("ACTION_TYPE: click", "CLICK", "click"),
        ("ACTION_TYPE=click", "CLICK", ""),
        ("Action  Type: click", "CLICK", "click"),
        ('input: Enter "Brooklyn"', "INPUT", "Brooklyn"),
        ("type: plain words ", "TYPE", "plain words"),
        (" FINISH ", "FINISH", ""),
        ("I would click", "", ""),
        ("ACTION_TYPE: clicking", "CLICK", "clicking"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_plan(spark, plan, kind, value):
    got = values(spark, [(plan,)], "p string", text.plan_action(F.col("p")), text.plan_value(F.col("p")))
    assert got == [(kind, value)]


def test_text_helpers(spark):
    c = F.col("x")
    rows = [(" a  b\n",), (None,), ("x" * 121,)]
    got = values(spark, rows, "x string", text.squeeze(c), text.shorten(text.squeeze(c), 120), text.head_tail(c, 10))
    assert got[0][:2] == ("a b", "a b") and got[1] == ("", "", None)
    assert got[2][1] == "x" * 120 + "..." and got[2][2] == "xxxxxx\n...\nxxxx"


def test_candidate_line_and_history(spark):
    df = spark.sql("SELECT named_struct('tag','a','text',' Go\n on ','attributes',map('role','it''s','class','z')) e, array('None','click: x') h")
    line, lines, empty = df.select(text.candidate_line(F.lit(2), F.col("e"), F.lit(0.5)), text.history_lines(F.col("h")), text.history_lines(F.array().cast("array<string>"))).first()
    assert line == '2. <a> text="Go on" attrs={\'role\': "it\'s"} (score: 0.5000)'
    assert lines == "0. None\n1. click: x" and empty == "(none)"


def test_vision_tokens_and_chat(spark):
    row = spark.sql("SELECT 'a <|vision_start|>x\ny<|vision_end|> b<|image_pad|> ' t").select(text.without_vision_tokens(F.col("t")), text.chat_message(F.lit("hi"), F.lit(None).cast("string")), text.chat_message(F.lit("hi"), F.lit("u"))).first()
    assert row[0] == "a [see attached screenshot] b"
    assert [p["type"] for p in json.loads(row[1])["content"]] == ["text"] and len(json.loads(row[2])["content"]) == 2


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"action_type":"click","target":null,"value":null,"confidence":0.9}', {"action_type": "click", "confidence": 0.9}),
        ('```json\n{"action_type": "type", "value": "a"}\n```', {"action_type": "type", "value": "a"}),
        ('```\n{"action_type": "noop"}\n```', {"action_type": "noop"}),
        ('{"action_type":"click","target":null,}', {"action_type": "click"}),
        ('Here is the action: {"action_type":"scroll"} done.', {"action_type": "scroll"}),
        ('{"action_type":"click"}', {"target": None, "confidence": 0.5}),
        ("{'action_type': 'click'}", {"action_type": "click"}),
        ('"action": "noop", "confidence": 0.25', {"action_type": "noop", "confidence": 0.25}),
        ('{"action":"click"}', {"action_type": "click"}),
        ("", None), (None, None), ("5", None), ("[1]", None), ("action is click", None),
    ],
)
def test_repair(raw, want):
    got, error = jsonfn.repair_action(raw)
    if want is None:
        assert got is None and error
    else:
        assert want.items() <= json.loads(got).items() and error is None


def test_balanced_counts_braces_in_strings():
    assert jsonfn.balanced_object('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert jsonfn.balanced_object('{"a": "{"} z }') == '{"a": "{"} z }'
    assert jsonfn.balanced_object('{ {"a": 1}') == '{ {"a": 1}' and jsonfn.balanced_object("none") is None


def test_truth_fields(spark):
    rows = [('{"op":" click ","value":" v "}', ['{"backend_node_id":"1","attributes":{"backend_node_id":"2"}}', "junk", '{"backend_node_id":"3","attributes":{"backend_node_id":"3"}}']), ('{"op":"","action_type":"type","action_input":"w"}', []), ("CLICK", None), (None, None)]
    got = values(spark, rows, "o string, c array<string>", jsonfn.truth_operation(F.col("o")), jsonfn.truth_value(F.col("o")), jsonfn.truth_ids(F.col("c")))
    assert got == [("CLICK", "v", ["1", "2", "3"]), ("TYPE", "w", []), ("CLICK", "", []), ("", "", [])]


def test_geometry(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    w, h = F.lit(1280.0), F.lit(720.0)
    assert one(geometry.scaled(a(0.5, 0.5), w, h, 2))[0] == [640, 360]
    assert one(geometry.scaled(a(0.5, 0.5, 0.1, 0.1), F.lit(1920.0), F.lit(1080.0), 4))[0] == [960, 540, 192, 108]
    assert one(geometry.scaled(a(100, 200), w, h, 2))[0] == [100, 200]
    assert one(geometry.scaled(a(0, 0, 1, 1), w, h, 4))[0] == [0, 0, 1280, 720]
    assert one(geometry.scaled(a(0.5, 0.5), F.lit(None).cast("double"), h, 2))[0] == [0.5, 0.5]
    assert one(geometry.boxes_match(a(0, 0, 10, 10), a(24, 0, 10, 10)), geometry.boxes_match(a(0, 0, 10, 10), a(25, 0, 10, 10)), geometry.boxes_match(a(0, 0), a(0, 0))) == (True, False, False)
    assert one(geometry.box_corners(F.lit("1, 2,3,4")), geometry.box_corners(F.lit("1,2,3")))[:] == ([1, 2, 4, 6], None)
    assert one(geometry.clamp(F.lit("x")), geometry.clamp(F.lit("7")), geometry.ratio(F.lit(1), F.lit(0))) == (0.5, 1.0, 0.0)


@pytest.mark.parametrize(("model", "key"), [("gpt-4o", "gpt-4o"), ("gpt-4o-mini-2024-07-18", "gpt-4o-mini"), ("x/gpt-4o-mini", "gpt-4o-mini"), ("GPT-4o-2024", "gpt-4o"), ("other", "gpt-4o-mini"), (None, "gpt-4o-mini")])
def test_prices(spark, model, key):
    row = values(spark, [(model,)], "m string", cost.price_key(F.col("m")), cost.call_cost(F.lit("gpt-4o"), F.lit(1000), F.lit(100)))[0]
    assert row == (key, pytest.approx(0.0035))


def test_actions_and_operations_differ(spark):
    rows = [("click", "select"), ("click", "hover"), ("select", "hover"), ("input", "type"), ("", ""), (" Click", "click "), (None, "click")]
    got = values(spark, rows, "a string, b string", match.actions_match(F.col("a"), F.col("b")), match.operations_match(F.col("a"), F.col("b")))
    assert got == [(True, True), (True, True), (False, True), (False, True), (True, True), (True, True), (False, False)]


def test_step_matches(spark):
    c = F.col
    rows = [("3", ["3", "4"], "TYPE", "A ", " a"), ("", ["3"], "TYPE", "x", ""), ("3", [], "CLICK", "x", "y"), ("3", None, "INPUT", "x", "y")]
    got = values(spark, rows, "i string, ids array<string>, o string, p string, t string", match.element_found(c("i"), c("ids")), match.typed_value_matches(c("o"), c("p"), c("t")))
    assert got == [(True, True), (False, True), (False, True), (False, False)]


def test_target_cascade(spark):
    t = "struct<selector:string,bbox:array<double>,coords:array<double>,text:string>"
    box, far = [0.0, 0.0, 2.0, 2.0], [90.0, 0.0, 2.0, 2.0]
    rows = [(None, None), ((None, None, None, None), None), (("#A ", None, None, None), ("#a", None, None, None)), (("#a", box, None, None), ("#b", box, None, None)), (("", box, None, None), ("#b", box, None, None)), ((None, box, None, None), (None, far, None, None)), ((None, None, [1.0, 1.0], None), (None, None, [1.0, 9.0], None)), (("#a", None, None, None), (None, box, None, None))]
    got = values(spark, rows, f"a {t}, b {t}", match.targets_match(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, False, True, False, True, False, True, False]


def test_validation(spark):
    c = F.col
    rows = [("click", '{"selector":"#a"}', 0.5, None), ("type", '{"coords":[1,2]}', 0.5, "x"), ("type", '{"bbox":[1,2,3,4]}', 0.5, ""), ("click", '{"selector":"#a"}', 1.5, None), ("fly", None, 0.5, None), ("click", None, 0.5, None), ("scroll", None, 0.5, None), ("scroll", "{}", 0.5, None), ("noop", "{}", 0.5, None), ("noop", '{"selector":"a"}', 0.5, None), ("noop", None, float("nan"), None), (None, None, 0.5, None)]
    got = [g[0] for g in values(spark, rows, "k string, t string, c double, v string", decode.prediction_error(c("k"), c("t"), c("c"), c("v")))]
    assert [bool(g) for g in got] == [False, False, True, True, True, True, False, True, False, True, True, True]


def test_decode_lenient_and_strict(spark):
    df = spark.createDataFrame([("action is click on button",), ('{"action_type":"fly","confidence":3}',), ('{"action_type":"click","target":{"bbox":"0.5,0.5,0.1,0.1"},"confidence":0.5}',), ('{"action_type":"click"}',)], "raw string")
    got = [r["action"] for r in decode.decode_actions(df, "raw", F.lit(100.0), F.lit(200.0)).collect()]
    assert got[0]["action_type"] == "noop" and got[0]["confidence"] == 0.0
    assert got[1]["action_type"] == "noop" and got[1]["confidence"] == 1.0
    assert got[2]["target"]["bbox"] == [50, 100, 10, 20] and got[3] is None
    strict = decode.decode_actions(df, "raw", strict=True).collect()
    assert [r["success"] for r in strict] == [False, False, True, False] and all(r["error"] for r in strict if not r["success"])


def test_answers(spark):
    assert ranking.probe_of('Selected element: {"text": "Go"}') == "Go"
    assert ranking.probe_of("{'attributes': {'a': 'x', 'b': ''}}") == "x" and ranking.probe_of("3") is None and ranking.probe_of("{__import__('os')}") is None
    df = spark.sql("SELECT array(named_struct('score',0.5D,'element',named_struct('representation','buy now')),named_struct('score',0.9D,'element',named_struct('representation','go home')),named_struct('score',0.9D,'element',named_struct('representation','tie'))) c")
    pick = lambda a, p=None, **k: df.select(ranking.choose_element(F.lit(a), F.col("c"), F.lit(p) if p else None, **k)["element"]["representation"]).first()[0]
    assert pick("0") == "buy now" and pick("-2") == "tie" and pick("99") == "go home"
    assert pick("NO_MATCH") == "go home" and pick("NO_MATCH", allow_none=True) is None and pick("?", "now") == "buy now"


def test_html():
    page = """<div>a<button id=b>Go <b>on</b></button><a href=x>L<a href=y>M</a></a><input name=q><br><select></select><textarea>t</textarea>
    <label>l</label><span role=tab>r</span><i role=none>n</i><p tabindex=0 onclick=f() backend_node_id=7>once</p><!-- <a>no</a> --><script>var x="<a>";</script><a>open"""
    found = interactive(page)
    assert [e["tag"] for e in found] == ["button", "a", "a", "input", "select", "textarea", "label", "span", "p", "a"]
    assert found[0]["text"] == "Go on" and found[8]["attributes"]["backend_node_id"] == "7" and found[-1]["text"] == "open"
    assert interactive("") == [] and interactive(None) == [] and len(summary("<p>x</p>" * 600)) == 500
