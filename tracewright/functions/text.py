"""Text expressions, all built-in: they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PLAN_TYPES

_TYPES = "|".join(PLAN_TYPES)
#: Where a plan names its action, in order of precedence (fixed patterns).
PLAN_PATTERNS = (
    rf"(?iu)ACTION[_ ]?TYPE\s*[:=]\s*({_TYPES})",
    rf"(?iu)Action\s+Type\s*:\s*({_TYPES})",
    rf"(?iu)^({_TYPES})\s*:",
    r"(?iu)^\s*(FINISH)\s*$",
)
#: Where a plan shows the text to type: quoted, else the rest of the line (fixed patterns).
VALUE_PATTERNS = (r'(?iud)(?:input|type)\s*[:\-]\s*.*?"([^"]+)"', r"(?iud)(?:input|type)\s*:\s*(.+)")
#: Attributes that a candidate line shows (fixed values).
SHOWN_ATTRIBUTES = ("backend_node_id", "role", "name", "aria_label", "placeholder", "type", "value", "input_value")


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def or_null(x: Column) -> Column:
    """Empty text as null: a missing value in the data model is either."""
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(or_empty(x), r"(?U)\s+", " "))


def shorten(x: Column, n: int) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def head_tail(x: Column, limit: int = 2000) -> Column:
    """Long text as its first 60 % and last 40 % of ``limit`` characters."""
    head = int(limit * 0.6)
    cut = F.concat(F.substring(x, 1, head), F.lit("\n...\n"), F.right(x, F.lit(limit - head)))
    return F.when(F.char_length(x) <= limit, x).otherwise(cut)


def first_match(x: Column, patterns) -> Column:
    """First group of the first pattern that matches; empty if none does."""
    return F.coalesce(*(or_null(F.regexp_extract(x, p, 1)) for p in patterns), F.lit(""))


def plan_action(plan: Column) -> Column:
    return F.upper(first_match(strip(or_empty(plan)), PLAN_PATTERNS))


def plan_value(plan: Column) -> Column:
    return strip(first_match(or_empty(plan), VALUE_PATTERNS))


def element_label(target_repr: Column, reprs: Column) -> Column:
    """The target's own text, else all of the step's texts in a line."""
    return F.coalesce(or_null(strip(target_repr)), F.array_join(reprs, " | "), F.lit(""))


def quoted_map(m: Column) -> Column:
    """A string map as ``{'k': 'v', ...}``; a value with an apostrophe takes double quotes."""
    quote = lambda v: F.when(F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"')), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'")))
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(quote(e["key"]), F.lit(": "), quote(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def candidate_line(rank: Column, element: Column, score: Column) -> Column:
    """One line of a grounding prompt: rank, tag, text, chosen attributes, score."""
    attributes = element["attributes"]
    shown = F.filter(F.transform(F.array(*map(F.lit, SHOWN_ATTRIBUTES)), lambda k: F.struct(k.alias("key"), shorten(squeeze(attributes[k]), 80).alias("value"), attributes[k].isNull().alias("gone"))), lambda e: ~e["gone"])
    kept = F.map_from_entries(F.transform(shown, lambda e: F.struct(e["key"], e["value"])))
    return F.format_string('%d. <%s> text="%s" attrs=%s (score: %.4f)', rank, F.coalesce(element["tag"], F.lit("?")), shorten(squeeze(element["text"]), 120), F.coalesce(quoted_map(kept), F.lit("{}")), F.coalesce(score, F.lit(0.0)))


def choice_prompt(instruction: Column, plan: Column, candidates: Column) -> Column:
    """The grounding question about an array of struct<score,element>, best first."""
    lines = F.array_join(F.transform(candidates, lambda c, i: candidate_line(i, c["element"], c["score"])), "\n")
    return F.concat(
        F.lit("Select the best candidate for the next single action.\nReturn exactly one token: a 0-based candidate index, or NO_MATCH.\nNo JSON, no explanations.\n\nuser instruction: "),
        shorten(squeeze(instruction), 220),
        F.lit("\nplan: "),
        shorten(squeeze(plan), 200),
        F.lit("\n\nCandidates (scored, descending):\n"),
        lines,
        F.lit("\n\nAnswer:\n"),
    )


def dom_lines(elements: Column, limit: int = 50) -> Column:
    """The first elements of a page, numbered from 1."""
    line = lambda e, i: F.concat((i + 1).cast("string"), F.lit(". <"), or_empty(e["tag"]), F.lit('> "'), F.substring(squeeze(e["text"]), 1, 50), F.lit('" class='), F.substring(or_empty(e["attributes"]["class"]), 1, 30))
    return F.array_join(F.transform(F.slice(elements, 1, limit), line), "\n")


def history_lines(plans: Column) -> Column:
    """Earlier plans, numbered from 0; ``(none)`` without any."""
    lines = F.transform(plans, lambda p, i: F.concat(i.cast("string"), F.lit(". "), or_empty(p)))
    return F.when(F.size(plans) > 0, F.array_join(lines, "\n")).otherwise("(none)")


def step_prompt(instruction: Column, plans: Column) -> Column:
    """The engine's own prompt for the next step of a task."""
    return F.concat(
        F.lit("Task: "), or_empty(instruction),
        F.lit("\nDone so far:\n"), history_lines(plans),
        F.lit(f"\nAnswer with one line, ACTION_TYPE: one of {', '.join(PLAN_TYPES)}, and the target."),
    )


def few_shot(examples: Column, limit: int = 3) -> Column:
    """Up to three struct<instruction,response> examples as text."""
    show = lambda e: F.concat(F.lit("Instruction: "), or_empty(e["instruction"]), F.lit("\nAction: "), or_empty(e["response"]))
    return F.array_join(F.transform(F.slice(examples, 1, limit), show), "\n\n")


def decode_prompt(template: Column, elements: Column, examples: Column, query: Column) -> Column:
    """Template, page, examples (if any) and query, set apart by blank lines."""
    return F.concat_ws("\n\n", template, or_null(dom_lines(elements)), or_null(few_shot(examples)), query)


def without_vision_tokens(x: Column) -> Column:
    """Image placeholders of a chat template as plain words."""
    marked = F.regexp_replace(x, r"(?s)<\|vision_start\|>.*?<\|vision_end\|>", "[see attached screenshot]")
    return strip(F.regexp_replace(marked, r"<\|(vision_start|vision_end|image_pad)\|>", ""))


def chat_message(text: Column, image_url: Column) -> Column:
    """A user message as JSON: an image part if there is one, then the text."""
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("url"))
    none = F.lit(None).cast("string")
    parts = F.filter(F.array(part("image_url", none, image_url), part("text", text, none)), lambda p: p["text"].isNotNull() | p["url"].isNotNull())
    return F.to_json(F.struct(F.lit("user").alias("role"), parts.alias("content")))
