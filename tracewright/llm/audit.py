"""Audit of how text filters interact, in every order of applying them.

Tasks scan the buffers of Arrow string columns: tables of byte classes and prefix
sums count words, capitals and symbols of many documents at once, sorted word
hashes (equal ones verified byte by byte) count distinct words.  A document becomes
a mask of the filters it fails; orders are then evaluated on counts of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import durable, slices, tidy

#: Filters in the order of their bits, and every order of applying them.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: Bytes of text that a worker looks at together.
SLICE = 2 << 20
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _class(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


SPACE, CAPITAL, SYMBOL = _class([0x20, *range(0x09, 0x0E)]), _class(range(65, 91)), _class(SYMBOLS)
#: First bytes of code points: all but continuation bytes.
POINT = ~_class(range(0x80, 0xC0))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], bytes_[at[0] : at[-1]]


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int, word: np.ndarray) -> np.ndarray:
    """Distinct words of each row, given the words' spans, rows and hashes.

    Words are sorted by row and hash; neighbours of one hash are the same word only if
    their bytes are.  A row with two words of one hash is counted as a set instead.
    """
    order = np.lexsort((word, row))
    same = (row[order[1:]] == row[order[:-1]]) & (word[order[1:]] == word[order[:-1]])
    a, b = order[:-1][same], order[1:][same]
    size = end - start
    unlike = size[a] != size[b]
    n = np.where(unlike, 0, size[a])
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = data[np.repeat(start[a], n) + inside] != data[np.repeat(start[b], n) + inside]
    unlike[np.repeat(np.arange(len(a)), n)[differ]] = True
    out = np.bincount(row, minlength=rows) - np.bincount(row[b], minlength=rows)
    for r in np.unique(row[a[unlike]]):
        out[r] = len({data[s:e].tobytes() for s, e in zip(start[row == r], end[row == r], strict=True)})
    return out


def masks(column: pa.Array, word_hash=hashing.hashed) -> np.ndarray:
    """The bits of the filters A to D that each text fails."""
    at, data = buffers(column)
    rows = len(column)
    space = np.append(SPACE[data], True)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # rows meet without a space between them
    begins = ~space[:-1] & (np.append(True, space[:-2]) if len(data) > 1 else np.ones(len(data), bool))
    begins |= ~space[:-1] & edge[:-1]
    ends = ~space[:-1] & (space[1:] | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(at, start, side="right") - 1
    n = np.bincount(row, minlength=rows)
    unlike = distinct(data, start, end, row, rows, word_hash(data, start, end))
    fails = [
        n < MIN_WORDS,
        100 * unlike < MIN_DISTINCT_PERCENT * n,
        100 * per_row(CAPITAL[data], at) > MAX_CAPITAL_PERCENT * per_row(POINT[data], at),
        per_row(SYMBOL[data], at) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def scan(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, part, mask (filters A to D) and digest (SHA-256 of the text) of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            at, data = buffers(b.column(2))
            view = memoryview(data)
            digests = [sha256(view[i:j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks(b.column(2))), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    blank = F.lit("")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), blank).alias("part"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    return df.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, mask of all five filters and labels.

    Rows of one text have one mask, so a text's rows only matter as counts: by id,
    then by part and labels, then as a whole.  Each step combines map-side, and a text
    with a third of all rows ends as a few counts of each partition.  The first id's rows
    (all of them, if the id is repeated) are the ones that don't fail E.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    none = F.lit(False)
    marked = rows.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    unnamed = rows.where("doc_id is null").withColumns({"good": none, "toxic": none})
    key = ["digest", "mask", "part", "good", "toxic"]
    by_id = marked.unionByName(unnamed).groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    by_text = by_id.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("at"), F.col("n").alias("n"))).alias("first"))
    first = F.min("first.at").over(Window.partitionBy("digest", "mask"))
    kinds = by_text.withColumn("firsts", F.when(F.col("first.at") == first, F.col("first.n")).otherwise(0))
    either = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    split = kinds.select("part", "good", "toxic", F.explode(either).alias("c"))
    return split.groupBy("part", "good", "toxic", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n")).where("n > 0")


def orders_of(mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, list]:
    """The counts of every order and step over one part's cells."""
    out: dict[str, list] = {c: [] for c in ["filter_order", "step", *COUNTS]}
    shares = dict.fromkeys(LETTERS, 0)
    for order in ORDERS:
        gone = np.zeros(len(mask), bool)
        for step, letter in enumerate(order, 1):
            fails = mask >> LETTERS.index(letter) & 1 == 1
            here = fails & ~gone
            row = [order, step, n[~gone & ~fails].sum(), n[here].sum(), n[fails & gone].sum(), n[mask == 1 << LETTERS.index(letter)].sum(), n[here & good].sum(), n[here & toxic].sum()]
            shares[letter] += int(row[3])
            for c, x in zip(out, row, strict=False):
                out[c].append(x)
            gone |= fails
    out["shapley"] = [shares[o[s - 1]] for o, s in zip(out["filter_order"], out["step"], strict=True)]
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null parts and texts count as empty ones.  Null ids come after all others and have
    no labels; rows of one id are equally small, so none of them repeats another.  A
    document is good or toxic if any of its label rows says so.  Texts are scanned once
    where they are; digests and masks are shuffled, never texts.  An empty table has no
    parts and gives no rows.  A task of the last step holds a part's masks and labels,
    at most 128 counts.
    """
    rows = durable(scan(docs, id_col, part_col, text_col), "masks")

    def evaluate(part: pd.DataFrame) -> pd.DataFrame:
        got = orders_of(*(part[c].to_numpy() for c in ("mask", "n", "good", "toxic")))
        return pd.DataFrame({"part": part["part"].iloc[0]} | got)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return cells(rows, labels).groupBy("part").applyInPandas(evaluate, schema)
