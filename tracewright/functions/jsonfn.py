"""JSON in model output and ground truth.

Field access is built-in, and so are the readings of model output that is JSON as a
whole or holds a balanced object.  Only texts that need a repair go to Python, in
Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import or_null, strip
from .udf import batch_udf

#: Last resort for unreadable output: single fields by pattern (fixed patterns).
_RESCUE = {
    "action_type": re.compile(r'"action(?:_type)?"\s*:\s*"([^"]+)"', re.IGNORECASE),
    "confidence": re.compile(r'"confidence"\s*:\s*([0-9.]+)', re.IGNORECASE),
    "value": re.compile(r'"value"\s*:\s*"([^"]*)"', re.IGNORECASE),
}
_BRACE, _FLAT = re.compile(r"[{}]"), re.compile(r"\{[^}]*\}")


def balanced_object(text: str) -> str | None:
    """From the first brace to the one that closes it (braces in strings count too),
    else the first flat pair of braces."""
    start = text.find("{")
    if start < 0:
        return None
    open_braces = 0
    for m in _BRACE.finditer(text, start):
        open_braces += 1 if m[0] == "{" else -1
        if not open_braces:
            return text[start : m.end()]
    flat = _FLAT.search(text)
    return flat[0] if flat else None


def tidy(text: str) -> str:
    """Without a code fence's marks and commas before a closing bracket."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```json?\s*", "", text.strip()))
    return re.sub(r",\s*([}\]])", r"\1", text)


def double_quotes(text: str) -> str:
    """Single quotes as double ones, unless a backslash stands before them."""
    return re.sub(r"(?<!\\)'", '"', text)


def parse_loose(text: str | None) -> tuple[object, str | None]:
    """The first reading of a text that is JSON, and an error if there is none."""
    if not text:
        return None, "Empty input text"
    inner = balanced_object(text)
    tidied = tidy(inner or text)
    error = ""
    for attempt in (text, inner, tidied, double_quotes(tidied)):
        if attempt:
            try:
                return json.loads(attempt), None
            except ValueError as e:
                error = str(e)
    found = {k: p.search(text) for k, p in _RESCUE.items()}
    if found["action_type"]:
        try:
            confidence = float(found["confidence"][1]) if found["confidence"] else 0.5
        except ValueError as e:
            return None, f"Unreadable after every repair: {e}"
        return {"action_type": found["action_type"][1], "target": None, "value": found["value"] and found["value"][1], "confidence": confidence}, None
    return None, f"Unreadable after every repair: {error}"


def with_defaults(parsed: dict) -> dict:
    out = {"target": None, "value": None, "confidence": 0.5} | parsed
    if "action_type" not in out and "action" in out:
        out["action_type"] = out["action"]
    return out


def repair_action(text: str | None) -> tuple[str | None, str | None]:
    """Action JSON with its defaults, or null and an error; JSON that is no object is an error."""
    parsed, error = parse_loose(text)
    if error:
        return None, error
    if not isinstance(parsed, dict):
        return None, "Not a JSON object"
    return json.dumps(with_defaults(parsed), ensure_ascii=False), None


@batch_udf("struct<json:string,error:string>")
def _repaired(text: pd.Series) -> pd.DataFrame:
    """Column form of :func:`repair_action`; texts that are null were read already."""
    return pd.DataFrame([(None, None) if t is None else repair_action(t) for t in text], columns=["json", "error"], dtype=object)


@batch_udf("struct<json:string,error:string>")
def _parsed(text: pd.Series) -> pd.DataFrame:
    """Column form of :func:`parse_loose`; texts that are null were read already."""
    found = [(None, None) if t is None else parse_loose(t) for t in text]
    return pd.DataFrame([(None if v is None else json.dumps(v, ensure_ascii=False), e) for v, e in found], columns=["json", "error"], dtype=object)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def balanced(text: Column) -> Column:
    """As :func:`balanced_object` without its last resort: a fold over the pieces that end with a brace."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        on = lambda depth: F.struct(depth.alias("depth"), (s["size"] + F.char_length(piece)).alias("size"), ((depth == 0) & piece.endswith("}")).alias("done"))
        return F.when(s["done"], s).otherwise(let(s["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0), on))

    def cut(after: Column) -> Column:
        end = F.aggregate(F.split(after, r"(?<=[{}])"), start, step, lambda s: F.when(s["done"], s["size"]))
        return let(end, lambda size: F.when(size.isNotNull(), after.substr(F.lit(1), size)))

    return F.when(F.instr(text, "{") > 0, let(text.substr(F.instr(text, "{"), F.char_length(text)), cut))


def _whole_object(text: Column) -> Column:
    """The text if it is one JSON object and nothing else, else null.

    The parser stops at the end of a value and ignores the rest, so the text is put into a
    list with its own hash after it: that is read only if the text is one value.
    """

    def read(mark: Column) -> Column:
        both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
        return F.try_variant_get(both, "$[1]", "long") == mark

    return F.when(text.startswith("{") & text.endswith("}") & let(F.xxhash64(text), read), text)


def read_object(text: Column) -> Column:
    """The text, or its balanced object, if that is sound JSON; else null.

    Readings come in the order of :func:`parse_loose`.  Texts that begin as a list or
    string may be JSON as a whole, and those that begin with a brace but go on after
    its match may be too (a brace in a string): these are left to it, as are texts
    that need a repair.
    """

    def others(trimmed: Column) -> Column:
        sound = ~trimmed.startswith("{") & ~trimmed.startswith("[") & ~trimmed.startswith('"')
        return F.coalesce(_whole_object(trimmed), F.when(sound, let(balanced(trimmed), _whole_object)))

    return F.when(F.instr(text, "{") > 0, let(strip(text), others))


def _filled(j: Column) -> Column:
    """An object's text with the defaults of :func:`with_defaults`; numbers keep the form they have."""

    def add(keys: Column) -> Column:
        lacks = lambda k: ~F.array_contains(keys, k)
        action = F.to_json(F.try_variant_get(F.try_parse_json(j), "$.action", "variant"))
        more = [F.when(lacks(k), f'"{k}": {v}') for k, v in (("target", "null"), ("value", "null"), ("confidence", "0.5"))]
        more.append(F.when(lacks("action_type") & ~lacks("action"), F.concat(F.lit('"action_type": '), F.coalesce(action, F.lit("null")))))
        body = F.concat(F.regexp_replace(j, r"\s*\}\s*$", ""), F.when(F.size(keys) > 0, ", ").otherwise(""))
        return let(F.concat_ws(", ", *more), lambda added: F.when(added == "", j).otherwise(F.concat(body, added, F.lit("}"))))

    return let(F.coalesce(F.json_object_keys(j), F.array().cast("array<string>")), add)


def _read_first(df: DataFrame, text: str, name: str, finish, rest) -> DataFrame:
    """``df`` with struct(json, error): the built-in reading, ``finish``ed, else what ``rest`` makes of the text.

    The reading is a column of its own first, so each row's is computed once.
    """
    found, c = f"__read_{name}", F.col(text)
    step = df.withColumn(found, let(read_object(c), lambda j: F.when(j.isNotNull(), finish(j))))
    empty = F.coalesce(c, F.lit("")) == ""
    step = step.withColumn(name, rest(F.when(F.col(found).isNull() & ~empty, c)))
    read = F.coalesce(F.col(found), F.col(f"{name}.json"))
    return step.withColumn(name, F.struct(read.alias("json"), F.when(empty, "Empty input text").when(read.isNull(), F.col(f"{name}.error")).alias("error"))).drop(found)


def repair_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with :func:`repair_action` of a text column: Python sees only texts that no built-in reading reads."""
    return _read_first(df, text, name, _filled, _repaired)


def parse_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with :func:`parse_loose` of a text column, without defaults."""
    return _read_first(df, text, name, lambda j: j, _parsed)


def required_error(parsed: Column, error: Column, keys: tuple[str, ...]) -> Column:
    """The parser's error, else the required keys that the object lacks, in the order asked; else null.

    The parsed value stays usable beside it.
    """
    there = F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, keys)), there)
    return F.coalesce(error, F.when(F.size(missing) > 0, F.concat(F.lit("Keys not found: "), F.array_join(missing, ", "))))


#: What a labelled answer, an object nested at most once, and its single fields look like (fixed patterns).
_LABELLED = re.compile(r"Output:\s*(\{.*?\})", re.DOTALL | re.IGNORECASE)
_SHALLOW = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")
_PARTS = {
    "action": re.compile(r'"action"\s*:\s*"([^"]+)"'),
    "target": re.compile(r'"target"\s*:\s*(\{[^}]+\}|null)'),
    "value": re.compile(r'"value"\s*:\s*"([^"]*)"'),
    "confidence": re.compile(r'"confidence"\s*:\s*([\d.]+)'),
}
_NO_VALUE = re.compile(r'"value"\s*:\s*null')


def extract_labelled(text: str | None) -> object:
    """The answer of a model that was asked for ``Output: {...}``: a labelled object, the
    whole text, the first readable object nested at most once, or all between the outer
    braces; else the single fields that can be found, or None."""

    def readings():
        labelled = _LABELLED.search(text)
        yield labelled[1] if labelled else ""
        yield text.strip()
        yield from (m[0] for m in _SHALLOW.finditer(text))
        yield text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""

    def read(attempt: str) -> tuple:
        try:
            return (json.loads(attempt),)
        except ValueError:
            return ()

    text = text or ""
    for attempt in filter(None, readings()):
        found = read(attempt)
        if found:
            return found[0]
    parts = {name: m[1] for name, pattern in _PARTS.items() if (m := pattern.search(text))}
    if "value" not in parts and _NO_VALUE.search(text):
        parts["value"] = None
    if "target" in parts:  # null, if it can't be read
        parts["target"] = (*read(parts["target"]), None)[0]
    if "confidence" in parts:  # left out, if it is no number
        number = read(parts.pop("confidence"))
        parts |= {"confidence": float(number[0])} if number else {}
    return parts or None


@batch_udf("string")
def extract_json(text: pd.Series) -> pd.Series:
    """Column form of :func:`extract_labelled`, as JSON text."""
    found = [extract_labelled(t) for t in text]
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False) for v in found], dtype=object)


def is_object(j: Column) -> Column:
    return F.coalesce(F.json_object_keys(j).isNotNull(), F.lit(False))


def field(j: Column, *names: str) -> Column:
    """First of the named fields that is neither missing nor empty."""
    return F.coalesce(*(or_null(F.get_json_object(j, f"$.{n}")) for n in names))


def truth_operation(operation: Column) -> Column:
    """Ground truth's operation in upper case; text that is no JSON stands for itself."""
    return F.upper(strip(F.coalesce(F.when(is_object(operation), F.coalesce(field(operation, "op", "action_type"), F.lit(""))), operation, F.lit(""))))


def truth_value(operation: Column) -> Column:
    return strip(F.coalesce(F.when(is_object(operation), field(operation, "value", "action_input")), F.lit("")))


#: What is read of a candidate.
_NODE = "struct<backend_node_id:string,attributes:struct<backend_node_id:string>>"


def truth_ids(candidates: Column) -> Column:
    """Node ids of ground-truth candidates: the outer one, then a nested one that is new.

    Each candidate is parsed once; one that is no object has no id.
    """

    def ids(c: Column) -> Column:
        outer, inner = or_null(c["backend_node_id"]), or_null(c["attributes"]["backend_node_id"])
        return F.array_compact(F.array(outer, F.when(~F.coalesce(inner == outer, F.lit(False)), inner)))

    read = F.transform(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: F.from_json(c, _NODE))
    return F.flatten(F.transform(F.filter(read, lambda c: c.isNotNull()), ids))


def oracle_action(operation: Column) -> Column:
    """Ground truth as an action: type, target (selector, text) and value.

    The operation before modification wins where it is given.
    """
    kind = F.upper(F.coalesce(field(operation, "original_op_before_modification", "op", "action_type"), F.lit("")))
    mapped = F.when(kind.isin("CLICK", "SELECT", "HOVER"), "click").when(kind == "TYPE", "type").when(kind == "SCROLL", "scroll").when(kind == "", "noop").otherwise(F.lower(kind))
    selector, text = field(operation, "selector", "element_css_selector"), field(operation, "text", "element_text")
    target = F.when(selector.isNotNull() | text.isNotNull(), F.struct(selector.alias("selector"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("array<double>").alias("coords"), text.alias("text")))
    return F.struct(mapped.alias("action_type"), target.alias("target"), field(operation, "value", "action_input").alias("value"))


def load_or_raw(c: Column) -> Column:
    """JSON text as it is; anything else wrapped as {"raw": ...}.  Nothing is evaluated."""
    return F.when(is_object(c), c).otherwise(F.to_json(F.struct(c.alias("raw"))))
