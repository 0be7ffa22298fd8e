"""Licence scans: one Aho-Corasick pass finds tags and notices, a shunting-yard
parser evaluates the and/or/with expressions that the tags carry."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Phrase and label of the base contract (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices that the method knows (fixed values).
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "eclipse public license": "epl",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Licences whose terms ask for little more than a notice (fixed values).
PERMISSIVE = frozenset("mit apache-2 bsd bsd-2 bsd-3 isc zlib unlicense cc0 public-domain".split())
#: Weight of a label as evidence: a tag is explicit, a notice is prose.
TAG_WEIGHT, NOTICE_WEIGHT = 0.95, 0.8

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LINE = re.compile(r"spdx-license-identifier\s*:?[ \t]*([^\n\r]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()]|\S")
_RANK = {"or": 1, "and": 2, "with": 3}


def label(identifier: str) -> str:
    """Identifier as a label: lower case, without -only, -or-later and .0."""
    x = re.sub(r"-(only|or-later)$", "", identifier.lower().rstrip("+"))
    x = re.sub(r"(?<=\d)\.0(\.0)?$", "", x)
    return re.sub(r"^(bsd-\d)-clause$", r"\1", x)


def postfix(expression: str) -> list[str] | None:
    """Shunting yard: operands and operators in evaluation order; None if malformed."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # was the last token an operand or a closing parenthesis
    for token in _TOKEN.findall(expression):
        t = token.lower()
        if t in _RANK and operand:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = False
        elif t == "(" and not operand:
            ops.append(t)
        elif t == ")" and operand:
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif re.fullmatch(r"[a-z0-9][a-z0-9.+:-]*", t) and t not in _RANK and not operand:
            out.append(label(token))
            operand = True
        elif operand and "(" not in ops and not re.match(r"[a-z0-9()]", t):
            break  # the comment's end follows the expression
        else:
            return None
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(rpn: list[str]) -> tuple[list[str], bool]:
    """Labels of an expression and whether it can be met by permissive terms only.

    ``a or b`` is permissive if one side is, ``a and b`` if both are; ``a with
    x`` keeps a's terms, as an exception only grants more.
    """
    stack: list[tuple[frozenset, bool]] = []
    for t in rpn:
        if t not in _RANK:
            stack.append((frozenset([t]), t in PERMISSIVE))
            continue
        (b, free_b), (a, free_a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((a, free_a))
        else:
            stack.append((a | b, free_a or free_b if t == "or" else free_a and free_b))
    names, free = stack[0]
    return sorted(names), free


def automaton():
    found = ahocorasick.Automaton()
    for phrase, name in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, name, phrase in BASE))
    found.make_automaton()
    return found


def scan(text: str, found) -> dict:
    """Everything that one text shows; positions count words from 0."""
    words = text.encode().translate(_WORD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, names, tagged = [], set(), False
    seen = blanks = 0  # places come in order, so blanks are counted once
    for end, (size, name, of_base) in found.iter(line):
        blanks += line.count(" ", seen, end + 1)
        seen = end + 1
        if not name:
            tagged = True
            continue
        if of_base:
            base.append({"start": blanks - 1 - size, "end": blanks - 1, "label": name})
        else:
            names.add(name)
    expressions, tags, free = [], set(), None
    if tagged:
        for m in _LINE.finditer(text):
            rpn = postfix(m[1])
            if rpn:
                labels, one = evaluate(rpn)
                tags.update(labels)
                expressions.append(" ".join(rpn))
                free = one if free is None else free and one
    base_labels = sorted({m["label"] for m in base})
    labels = sorted({*base_labels, *names, *tags})
    miss = 1.0
    for x in labels:
        miss *= 1 - (TAG_WEIGHT if x in tags else NOTICE_WEIGHT)
    return {"n_words": len(words), "matches": sorted(base, key=lambda m: (m["start"], m["label"])), "base_labels": base_labels, "labels": labels, "expressions": expressions, "permissive": free, "score": 1 - miss}


SCHEMA = "doc_id {id}, n_words long, matches array<struct<start:long,end:long,label:string>>, base_labels array<string>, labels array<string>, expressions array<string>, permissive boolean, score double"
_ARROW = [
    ("n_words", pa.int64()),
    ("matches", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
    ("base_labels", pa.list_(pa.string())),
    ("labels", pa.list_(pa.string())),
    ("expressions", pa.list_(pa.string())),
    ("permissive", pa.bool_()),
    ("score", pa.float64()),
]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: word count, places of the base phrases, labels,
    the tags' expressions in postfix order, permissive (null without a tag), score.

    Null and empty texts have no words, no labels and score 0; ids may be null or
    repeat (each row stands for itself); other columns are ignored.  A tag whose
    expression is malformed adds nothing.  One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in slices(batches):
            rows = [scan(t, found) for t in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in _ARROW)],
                names=["doc_id", *(k for k, _ in _ARROW)],
            )

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, SCHEMA.format(id=df.schema["doc_id"].dataType.simpleString()))
