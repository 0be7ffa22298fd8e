"""From raw model text to a validated action, as staged projections (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp, numbers, scaled
from ..functions.jsonfn import let, repair_json
from ..schemas import ACTION, ACTION_TYPES


def has_key(j: Column, key: str) -> Column:
    """Whether an object has a key, be its value null or empty."""
    return F.coalesce(F.array_contains(F.json_object_keys(j), key), F.lit(False))


def target_valid(kind: Column, target_json: Column) -> Column:
    """noop takes no target, scroll may do without, others need a box, selector or point."""
    empty = target_json.isNull() | (F.regexp_replace(target_json, r"\s", "") == "{}")
    given = has_key(target_json, "bbox") | has_key(target_json, "selector") | has_key(target_json, "coords")
    return F.when(kind == "noop", empty).when(target_json.isNull(), kind == "scroll").otherwise(given)


def prediction_error(kind: Column, target_json: Column, confidence: Column, value: Column) -> Column:
    """The first rule that an action breaks, in fixed order; null if it is valid.

    ``confidence`` is a double, null if it was no number; NaN is invalid.
    """
    sure = F.coalesce((confidence >= 0) & (confidence <= 1) & ~F.isnan(confidence), F.lit(False))
    return F.coalesce(
        F.when(kind.isNull(), "Missing required field: action_type"),
        F.when(~kind.isin(*ACTION_TYPES), F.concat(F.lit("Invalid action_type: "), kind)),
        F.when(~target_valid(kind, target_json), F.concat(F.lit("Invalid target for action_type="), kind)),
        F.when(~sure, "Invalid confidence"),
        F.when((kind == "type") & (F.coalesce(value, F.lit("")) == ""), "type action requires non-empty value field"),
    )


def require_valid(error: Column, value: Column) -> Column:
    """``value``, or a failed query where there is an error (the strict factory)."""
    return F.when(error.isNull(), value).otherwise(F.raise_error(error))


def _list(target: Column, key: str, size: int, width: Column, height: Column) -> Column:
    raw = F.get_json_object(target, f"$.{key}")
    return scaled(F.coalesce(F.from_json(raw, "array<double>"), numbers(raw)), width, height, size)


def decode_actions(df: DataFrame, text: str, width: Column | None = None, height: Column | None = None, strict: bool = False) -> DataFrame:
    """``df`` with struct column ``action`` and string columns ``parsed``, ``error``; boolean ``success``.

    Normalised boxes and points turn into pixels of ``width`` x ``height`` (each
    row's own).  Lenient mode (the default) makes unreadable text a noop of
    confidence 0 with its error kept, and mends a bad type, confidence or value
    before judging again; strict mode leaves both as errors.
    """
    width, height = (F.lit(None).cast("double") if x is None else x for x in (width, height))
    g = lambda k: F.get_json_object("__p.json", f"$.{k}")
    step = repair_json(df, text, "__p")
    target = g("target")
    step = step.withColumns({"__kind": g("action_type"), "__target": target, "__value": g("value"), "__raw": g("confidence")})
    # A quoted number is no number: its JSON text starts with a quote in the parent.
    quoted = F.regexp_extract("__p.json", r'"confidence"\s*:\s*(")', 1) != ""
    step = step.withColumn("__confidence", F.when(~quoted, F.col("__raw").try_cast("double")))
    broken = prediction_error(F.col("__kind"), F.col("__target"), F.col("__confidence"), F.col("__value"))
    step = step.withColumn("__error", broken)
    if not strict:
        fix = F.col("__error").isNotNull()
        known = F.col("__kind").isin(*ACTION_TYPES)
        step = step.withColumns({
            "__kind": F.when(fix & ~F.coalesce(known, F.lit(False)), F.coalesce(g("action"), F.lit("noop"))).otherwise(F.col("__kind")),
            "__confidence": F.when(fix, clamp(F.col("__confidence"))).otherwise(F.col("__confidence")),
        })
        again = prediction_error(F.col("__kind"), F.col("__target"), F.col("__confidence"), F.col("__value"))
        step = step.withColumn("__error", F.when(fix, again))
    target = F.col("__target")
    keys = F.array_intersect(F.json_object_keys(target), F.array(F.lit("bbox"), F.lit("selector"), F.lit("coords")))
    shaped = F.when(F.size(keys) > 0, F.struct(
        F.get_json_object(target, "$.selector").alias("selector"),
        _list(target, "bbox", 4, width, height).alias("bbox"),
        _list(target, "coords", 2, width, height).alias("coords"),
        F.get_json_object(target, "$.text").alias("text"),
    ))
    action = F.struct(F.col("__kind").alias("action_type"), shaped.alias("target"), F.col("__value").alias("value"), F.col("__confidence").alias("confidence"))
    readable = F.col("__p.json").isNotNull()
    noop = F.struct(F.lit("noop").alias("action_type"), F.lit(None).cast("struct<selector:string,bbox:array<double>,coords:array<double>,text:string>").alias("target"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"))
    out = F.when(readable & F.col("__error").isNull(), action)
    error = F.when(~readable, F.concat(F.lit("JSON parsing failed: "), F.col("__p.error"))).when(F.col("__error").isNotNull(), F.concat(F.lit("Schema validation failed: "), F.col("__error")))
    if not strict:
        out = out if strict else F.when(~readable, noop).otherwise(out)
    step = step.withColumns({"action": out, "parsed": F.col("__p.json"), "error": error})
    return step.withColumn("success", F.col("action").isNotNull()).drop("__p", "__kind", "__target", "__value", "__raw", "__confidence", "__error")


def to_text(action: Column) -> Column:
    """An action struct as JSON: its four fields always, of a target only what it has."""

    def value(x: Column) -> Column:
        return let(F.to_json(F.array(x)), lambda listed: listed.substr(F.lit(2), F.char_length(listed) - 2))

    def written(a: Column) -> Column:
        names = ("action_type", "target", "value", "confidence")
        fields = [F.concat(F.lit(f'"{n}":'), value(a[n])) for n in names]
        return F.when(a.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))

    return let(action, written)


def from_text(j: Column) -> Column:
    """The action of a JSON object; without the key, the type is noop and the confidence 0.

    A key that is there keeps its value, null included.  What is no object gives null.
    Text, keys and fields are each computed once for a row, however long the expression before.
    """

    def filled(read: Column, keys: Column) -> Column:
        out = read
        for name, default in (("action_type", "noop"), ("confidence", 0.0)):
            out = out.withField(name, F.when(F.array_contains(keys, name), read[name]).otherwise(default))
        return out

    def parsed(t: Column) -> Column:
        return let(F.json_object_keys(t), lambda keys: F.when(keys.isNotNull(), let(F.from_json(t, ACTION), lambda read: filled(read, keys))))

    return let(j, parsed)
