"""Benchmark decontamination by the q-gram lemma.

An occurrence of an m-character passage with at most e edits keeps m-q+1-q*e of
its q-grams, and they all lie on diagonals that differ by at most e.  So shared
q-grams are counted in overlapping diagonal bands; regions that reach the bound
are kept and verified by banded alignment.  q is 8, or less for passages so short
that 8-grams would not leave one for the whole edit budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices, texts, tidy, unused, without

#: Longest q-gram, which is also the shortest passage, and the edits allowed as a share of a passage's length.
Q, EDITS = 8, 0.1
#: Passages that go out at once; a larger benchmark is searched in blocks.
BLOCK = 20_000
#: Characters searched at once by a worker.
CHARS = 1_000_000
#: Rows of (document, passage, diagonal) and cells of an alignment held at once.
ROWS, CELLS = 1_000_000, 2_000_000
_U = np.uint64
_A = _U(0x9E3779B97F4A7C15)
_BITS = 22


def normalise(text: str) -> str:
    """Lower case, white space as one blank."""
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Latin-1 characters in lower case, white space as a blank.
_LATIN = bytes(32 if chr(c).isspace() else ord(chr(c).lower()) for c in range(256))
_BLANKS = re.compile(b"  +")


def fold(text: str) -> bytes:
    """The normalised text at one byte a character, for the filter only.

    Characters below 256 stand for themselves; others share bytes, which can only
    add candidates.  Verification compares the characters.
    """
    try:
        b = text.encode("latin-1").translate(_LATIN)
    except UnicodeEncodeError:
        x = points(normalise(text))
        return ((x ^ (x >> 8) ^ (x >> 16)) & 255).astype(np.uint8).tobytes()
    if b"  " in b:
        b = _BLANKS.sub(b" ", b)
    return b.strip(b" ")


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Each q-gram of folded characters as one 64-bit number, 8-grams by doubling."""
    if len(x) < q:
        return np.zeros(0, _U)
    if q < Q:
        h = np.zeros(len(x) - q + 1, _U)
        for k in range(q):
            h |= x[k : len(x) - q + 1 + k].astype(_U) << _U(8 * k)
        return h
    h = x[:-1].astype(np.uint16) | (x[1:].astype(np.uint16) << np.uint16(8))
    h = h[:-2].astype(np.uint32) | (h[2:].astype(np.uint32) << np.uint32(16))
    return h[:-4].astype(_U) | (h[4:].astype(_U) << _U(32))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * _A) >> _U(64 - _BITS)


@dataclass
class Index:
    """Q-grams of a block of passages.

    Where a q-gram stands is a list of (passage, position).  Lists that differ by one
    shift only, as those along a beginning that many passages share, are one class:
    a shared q-gram is met as (class, diagonal), and passages are told apart after
    equal diagonals are counted.
    """

    q: int
    ids: list
    passages: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    of_class: np.ndarray
    shift: np.ndarray
    entry: np.ndarray
    at: np.ndarray
    table: np.ndarray

    @classmethod
    def all_of(cls, items: list[tuple[object, str]], share: float = EDITS) -> list[Index]:
        """An index for each q: the longest, up to 8, with which a q-gram outlives the edits."""
        groups: dict[int, list] = {}
        for i, t in items:
            if t is not None and (size := len(normalise(t))) >= Q:
                groups.setdefault(max(1, min(Q, size // (int(size * share) + 1))), []).append((i, t))
        return [cls.of(group, share, q) for q, group in sorted(groups.items())]

    @classmethod
    def of(cls, items: list[tuple[object, str]], share: float, q: int) -> Index:
        items = sorted(((normalise(t), i, t) for i, t in items), key=lambda r: r[0])  # shared beginnings side by side
        passages, raw = [points(n) for n, _, _ in items], [t for _, _, t in items]
        size = np.array([len(p) for p in passages], np.int64)
        edits = (size * share).astype(np.int64)
        found = [grams(np.frombuffer(fold(t), np.uint8), q) for t in raw]
        h = np.concatenate([np.zeros(0, _U), *found])
        item = np.repeat(np.arange(len(items)), [len(g) for g in found])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in found)])
        order = np.argsort(h, kind="stable")
        item, at = item[order], at[order]
        keys, first = np.unique(h[order], return_index=True)
        many = np.diff(np.append(first, len(h)))
        shift = at[first]
        at -= np.repeat(shift, many)
        # A class for each passage (its q-grams of one place), then one for each list of more places.
        of_class, entries, places, classes = item[first].astype(np.int64), [np.arange(len(items))], [np.zeros(len(items), np.int64)], {}
        for k in np.flatnonzero(many > 1).tolist():
            one = slice(first[k], first[k] + many[k])
            name = item[one].tobytes() + at[one].tobytes()
            if name not in classes:
                classes[name] = len(items) + len(classes)
                entries.append(item[one] + classes[name] * len(items))
                places.append(at[one])
            of_class[k] = classes[name]
        entries[0] = entries[0] * (len(items) + 1)
        table = np.zeros(1 << _BITS, bool)
        table[_slot(keys)] = True
        return cls(q, [i for _, i, _ in items], passages, edits, size - q + 1 - q * edits, keys, of_class, shift, np.concatenate(entries), np.concatenate(places), table)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in x, class, diagonal) of each shared q-gram."""
        h = grams(x, self.q)
        where = np.flatnonzero(self.table[_slot(h)])
        if not len(where) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        k = np.searchsorted(self.keys, h[where])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == h[where]
        where, k = where[same], k[same]
        return where, self.of_class[k], where - self.shift[k]

    def regions(self, x: np.ndarray, offset: np.ndarray) -> Iterator[np.ndarray]:
        """Candidates as rows (document, passage, first diagonal of the band), by ranges of
        passages, each of which is kept in bounded memory; a row may come twice."""
        pos, kind, diagonal = self.hits(x)
        if not len(pos):
            return
        doc, kind, diagonal, count = _summed(np.searchsorted(offset, pos, side="right") - 1, kind, diagonal, np.ones(len(pos), np.int64))
        n = len(self.ids)
        todo = [(0, n)]
        while todo:
            low, high = todo.pop()
            begin = np.searchsorted(self.entry, kind * n + low)
            many = np.searchsorted(self.entry, kind * n + high) - begin
            ends = np.cumsum(many)
            if ends[-1] > ROWS and high - low > 1:
                todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
                continue
            sums: list[list] = [[], []]
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(ROWS, ends[-1], ROWS)), len(many)))
            for a, z in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                part = many[a:z]
                if not part.sum():
                    continue
                flat = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part) + np.repeat(begin[a:z], part)
                item = self.entry[flat] % n
                step = self.edits[item] + 1
                d, place, c = np.repeat(doc[a:z], part), np.repeat(diagonal[a:z], part) - self.at[flat], np.repeat(count[a:z], part)
                for half in (0, 1):  # bands of two steps, each starting one step after the last
                    sums[half].append(_summed(d, item, (place - half * step) // (2 * step), c))
            rows = []
            for half, parts in enumerate(sums):
                if not parts:
                    continue
                d, i, band, c = parts[0] if len(parts) == 1 else _summed(*np.concatenate(parts, axis=1))
                good = c >= self.bound[i]
                d, i, band = d[good], i[good], band[good]
                step = self.edits[i] + 1
                rows.append(np.stack([d, i, band * 2 * step + half * step], axis=1))
            if rows:
                yield np.concatenate(rows)


def _summed(doc: np.ndarray, item: np.ndarray, band: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts summed by (document, passage or class, band or diagonal), as four rows."""
    many, low = int(item.max()) + 1, int(band.min())
    wide = int(band.max()) - low + 1
    key = (doc * many + item) * wide + band - low  # a batch's documents and characters keep it below 2**63
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    pair, place = np.divmod(key[cut], wide)
    return np.stack([*np.divmod(pair, many), place + low, np.add.reduceat(count[order], cut)])


def align(passages: list[np.ndarray], x: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded semi-global alignment of many pairs at once.

    Pair c aligns passages[c] with x[low[c]:high[c]] on the diagonals start[c] ..
    start[c]+width-1; returns the least number of edits (above its budget: no matter
    how many), where it begins and where it ends.  Neighbours with one start and one
    range share the rows of the beginning their passages have in common, and rows over
    budget are left.
    """
    n, size = len(passages), np.array([len(p) for p in passages])
    m = int(size.max())
    text = np.zeros((n, m), np.uint32)
    for c, p in enumerate(passages):
        text[c, : len(p)] = p
    differ = text[1:] != text[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
    shared = np.minimum(shared, np.minimum(size[1:], size[:-1]))
    shared = np.r_[-1, np.where((start[1:] == start[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1]), shared, -1)]

    # A cell is edits * 2**32 + what is left to a late beginning: the least is the best, then the shortest.
    one, far, step = np.int64(1 << 32), np.int64(1 << 62), np.arange(width)
    alive, heads = np.arange(n), np.flatnonzero(shared < 0)
    row = np.cumsum(shared < 0) - 1
    place = start[heads, None] + step
    cost = np.where((place >= low[heads, None]) & (place <= high[heads, None]), high[heads, None] - place, far)
    out = np.full(n, far), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(m):
        new = np.r_[True, row[1:] != row[:-1]] | (shared[alive] == i)
        cost, heads, row = cost[row[new]], alive[new], np.cumsum(new) - 1
        at = start[heads, None] + step + i
        lows, highs = low[heads, None], high[heads, None]
        inside = (at >= lows) & (at < highs)
        char = x[np.clip(at, 0, len(x) - 1)]
        after = np.where(inside, cost + (char != text[heads, i : i + 1]) * one, far)
        after[:, :-1] = np.minimum(after[:, :-1], cost[:, 1:] + one)  # a character of the passage is missing
        valid = (at + 1 >= lows) & (at + 1 <= highs)
        after = np.where(valid, after, far)
        after = np.minimum.accumulate(after - step * one, axis=1) + step * one  # extra characters in the text
        cost = np.where(valid, np.minimum(after, far), far)
        ended = size[alive] == i + 1
        if ended.any():
            done, r = alive[ended], row[ended]
            best = np.argmin(cost[r], axis=1)
            least = cost[r, best]
            out[0][done] = least >> 32
            out[1][done] = high[done] - (least & (one - 1))
            out[2][done] = at[r, best] + 1
        left = np.maximum.reduceat(budget[alive], np.flatnonzero(new))
        stay = ((cost.min(axis=1) >> 32) <= left)[row] & ~ended
        alive, row = alive[stay], row[stay]
        if not len(alive):
            break
    return out


def search(docs: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, passage, start, end, edits) of the best region of each pair within the budget.

    Of regions with equally few edits the first is taken.
    """
    if not index.ids:
        return []
    folded = [fold(t) for t in docs]
    x = np.frombuffer(b"\0".join(folded), np.uint8)
    offset = np.cumsum([0, *(len(f) + 1 for f in folded)])
    lengths = np.array([len(p) for p in index.passages])
    held: dict[int, np.ndarray] = {}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for rows in index.regions(x, offset):
        doc, item, first = rows.T
        edits = index.edits[item]
        first = first - offset[doc] - edits
        order = np.lexsort((item, first, doc, edits))
        doc, item, first, edits = doc[order], item[order], first[order], edits[order]
        sizes, at = lengths[item], 0
        while at < len(doc):
            cells = np.arange(1, len(doc) - at + 1) * np.maximum(4 * edits[at:] + 4, np.maximum.accumulate(sizes[at:]))
            one = slice(at, at + max(1, int(np.searchsorted(cells, CELLS, side="right"))))
            at = one.stop
            d, i, e = doc[one], item[one], edits[one]
            here = np.unique(d)
            held.update({k: points(normalise(docs[k])) for k in here.tolist() if k not in held})
            base = np.cumsum([0, *(len(held[k]) for k in here.tolist())])
            k = np.searchsorted(here, d)
            cost, begin, end = align([index.passages[j] for j in i.tolist()], np.concatenate([held[k] for k in here.tolist()]), first[one] + base[k], base[k], base[k + 1], 4 * int(e.max()) + 4, e)
            for j in np.flatnonzero(cost <= e).tolist():
                pair, got = (int(d[j]), int(i[j])), (int(cost[j]), int(end[j] - base[k[j]]), int(begin[j] - base[k[j]]))
                if pair not in best or got < best[pair]:
                    best[pair] = got
    return [(d, i, begin, end, c) for (d, i), (c, end, begin) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", share: float = EDITS) -> DataFrame:
    """One row per document and passage found in it: doc_id, item_id, start_char,
    end_char (in the normalised text), edits, similarity (1 - edits/length).

    A passage counts as found if some region of the document differs from it by at
    most ``share`` of its characters, after lower-casing and joining white space.
    Null or empty texts and passages below 8 characters match nothing; a repeated
    id gives rows for each of its rows; an empty benchmark gives no rows.  The
    benchmark is read in blocks of 20,000 passages, each broadcast; one narrow pass
    over the documents per block, no shuffle.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("text"))
    kinds = {n: df.schema[n].dataType.simpleString() for n in ("doc_id",)} | {"item_id": items.schema["item_id"].dataType.simpleString()}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start_char long, end_char long, edits long, similarity double"

    def block(rows: list) -> DataFrame:
        index = spark.sparkContext.broadcast(Index.all_of(rows, share))

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                part, size = [], 0
                for k, t in enumerate(texts(b)):
                    part.append((k, t))
                    size += len(t)
                    if size >= CHARS:
                        yield from (out(b, part, x) for x in index.value)
                        part, size = [], 0
                yield from (out(b, part, x) for x in index.value)

        def out(b: pa.RecordBatch, part: list, x: Index) -> pa.RecordBatch:
            got = search([t for _, t in part], x) if part else []
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([part[g[0]][0] for g in got], pa.int64())),
                    pa.array([x.ids[g[1]] for g in got]).cast(item_type) if got else pa.array([], item_type),
                    *(pa.array([g[k] for g in got], pa.int64()) for k in (2, 3, 4)),
                    pa.array([1 - g[4] / len(x.passages[g[1]]) for g in got], pa.float64()),
                ],
                names=["doc_id", "item_id", "start_char", "end_char", "edits", "similarity"],
            )

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema["item_id"].dataType)
        return df.mapInArrow(run, schema)

    blocks, rows = [], []
    for r in items.toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) == BLOCK:
            blocks.append(block(rows))
            rows = []
    if rows or not blocks:
        blocks.append(block(rows))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no passage is found.

    Rows are told by id and a hash of their text, so null and repeated ids are
    judged row by row; no text is shuffled but those that go.
    """
    name = unused(docs, "hash")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    pair = keyed.select(F.struct("doc_id", name).alias("pair"), F.col("text").cast("string").alias("text"))
    found = contaminated(pair, benchmark, id_col="pair")
    bad = durable(found.select("doc_id.doc_id", f"doc_id.{name}").distinct(), "contaminated")
    return without(keyed, bad, ["doc_id", name]).drop(name)
