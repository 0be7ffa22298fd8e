"""Elements of web pages: a lenient parser in Arrow batches.

Contract: elements come in document order and once each; void elements have no
text; an unclosed element ends where its parent ends; script and style text counts as
text of an enclosing element, comments don't.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd

from ..schemas import ELEMENT
from .udf import batch_udf

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ACTIVE_TAGS = frozenset("button a input select textarea label".split())
ACTIVE_ROLES = frozenset("button tab menuitem option link checkbox radio switch combobox listbox".split())
ACTIVE_ATTRIBUTES = frozenset("tabindex onclick backend_node_id".split())
SUMMARY_TAGS = frozenset("a button input textarea select label div span p".split())


class _Tree(HTMLParser):
    """Collects the wanted elements as [tag, attributes, start, end], a range of ``pieces`` of text."""

    def __init__(self, wanted) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.found, self.open, self.pieces, self.depth = wanted, [], [], [], Counter()

    def handle_starttag(self, tag, attrs):
        attributes = {}
        for k, v in attrs:
            attributes.setdefault(k, v or "")
        node = [tag, attributes, len(self.pieces), len(self.pieces)] if self.wanted(tag, attributes) else None
        if node:
            self.found.append(node)
        if tag not in VOID:
            self.open.append((tag, node))
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.depth[tag]:
            while self.end_innermost() != tag:
                pass

    def end_innermost(self):
        tag, node = self.open.pop()
        self.depth[tag] -= 1
        if node:
            node[3] = len(self.pieces)
        return tag

    def handle_data(self, data):
        self.pieces.append(data)


def _parse(html: str | None, wanted, limit: int | None = None) -> list:
    tree = _Tree(wanted)
    tree.feed(html or "")
    tree.close()
    while tree.open:
        tree.end_innermost()
    return [(tag, attributes, tree.pieces[start:end]) for tag, attributes, start, end in tree.found[:limit]]


def is_active(tag: str, attributes: dict) -> bool:
    return tag in ACTIVE_TAGS or attributes.get("role") in ACTIVE_ROLES or not ACTIVE_ATTRIBUTES.isdisjoint(attributes)


def interactive(html: str | None) -> list[dict]:
    out = []
    for i, (tag, attributes, pieces) in enumerate(_parse(html, is_active)):
        text = "".join(pieces).strip()
        out.append({"index": i, "tag": tag, "text": text, "attributes": attributes, "representation": f"<{tag}> text='{text}' attrs={attributes}"})
    return out


def summary(html: str | None, limit: int = 500) -> list[dict]:
    out = []
    for tag, attributes, pieces in _parse(html, lambda t, _: t in SUMMARY_TAGS, limit):
        text = " ".join(p.strip() for p in pieces if p.strip())[:200]
        out.append({"tag": tag, "text": text, "id": attributes.get("id"), "class": attributes.get("class"), "attrs": attributes})
    return out


@batch_udf(f"array<{ELEMENT}>")
def interactive_elements(html: pd.Series) -> pd.Series:
    """What a user can act on: six tags, ten roles, and three marking attributes."""
    return html.map(interactive)


@batch_udf("array<struct<tag:string,text:string,id:string,class:string,attrs:map<string,string>>>")
def dom_summary(html: pd.Series) -> pd.Series:
    """The first 500 elements of nine common tags."""
    return html.map(summary)
