"""Substring dedup with fixed-block anchors.

Reference texts are cut into non-overlapping blocks of half a window; every window
of WINDOW words holds at least one whole block.  All rolling block-sized windows
probe the blocks, and a block that is hit from elsewhere is an anchor.  Runs of
windows whose own blocks are all anchors are the places where a repeat can be; their
windows meet by hash, which tells those that start in a document with a smaller id.
Neighbouring ones join into maximal repeated spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, durable, ordinal, release, slices, tidy
from .hashing import U, mix, windows, words

WINDOW = 50
BLOCK = WINDOW // 2
#: A window with more than this share of the candidates' rows (one in HOT) is broadcast
#: instead of shuffled; a task finds such windows with four times as many counters.
HOT = 1024
#: Hashes that a worker gathers before it counts them.
GATHERED = 1_000_000
_OTHER = U(0x8A5CD789635D2DFF)


def _data(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in b.column(b.schema.get_field_index("text")).to_pylist()]


def _digest(data: bytes) -> bytes | None:
    """128 bits of a text's words; none below a window."""
    w = data.split()
    return blake2b(b" ".join(w), digest_size=16).digest() if len(w) >= WINDOW else None


def _row(digest: bytes | None) -> int:
    """What tells rows of one id apart."""
    return int.from_bytes(digest[:8], "little", signed=True) if digest else 0


def _place(ords: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(rows.view(U) ^ mix(ords.view(U)))


class Rows:
    """A set of rows (ord, row) as two bitmaps: ids, and ids with rows.

    Digests are made only for texts whose id is in the first.
    """

    def __init__(self, table: DataFrame) -> None:
        longs = lambda b: [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        self.ids, self.places = Bits.of(table.select("ord")), Bits.of(table.select("ord", "row"), lambda b: _place(*longs(b)))

    def has(self, ords: np.ndarray, data: list[bytes]) -> np.ndarray:
        out = self.ids.has(ords.view(U))
        at = np.flatnonzero(out)
        rows = np.array([_row(_digest(data[i])) for i in at], np.int64)
        out[at] = self.places.has(_place(ords[at], rows))
        return out


def _check(word: np.ndarray) -> np.ndarray:
    """A second, short hash of each window."""
    return (windows(mix(word ^ _OTHER), WINDOW) >> U(48)).astype(np.uint16).view(np.int16)


def covered(n: int, starts: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Which of n words are in a window of k words that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(flag: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def frequent(seen: DataFrame, k: int = HOT) -> DataFrame:
    """The values of h that have more than about a share of 1/k of the rows: fewer than k.

    A task keeps 4k counters and subtracts what falls below them, so it sends at most 4k.
    The share is the same at every size.
    """
    counters, share = 4 * k, seen.count() // k

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> None:
            nonlocal keys, counts
            h, at = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, *(np.ones(len(x), np.int64) for x in waiting)]), len(h)).astype(np.int64)
            n -= np.partition(n, len(n) - counters - 1)[len(n) - counters - 1] if len(n) > counters else 0
            keys, counts = h[n > 0], n[n > 0]
            waiting.clear()

        for b in batches:
            waiting.append(b.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, waiting)) > GATHERED:
                merged()
        merged()
        keys, counts = keys[counts > 1], counts[counts > 1]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["h", "n"])

    return seen.select("h").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > share).select("h")


def flagged(seen: DataFrame) -> DataFrame:
    """The rows (h, check, ord, ...) of windows that a smaller ord has too.

    The first ord of a window is a minimum, combined map-side.  Frequent windows get
    theirs by a broadcast; the others meet theirs in one shuffle.
    """
    firsts = [F.min("ord").alias("first"), F.max("ord").alias("last")]
    hot = durable(frequent(seen), "frequent")
    top = seen.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "check").agg(*firsts).where("first < last").drop("last")
    heavy = seen.join(F.broadcast(top), ["h", "check"])
    light = seen.join(F.broadcast(hot), "h", "left_anti").repartition("h", "check")
    rest = light.join(light.groupBy("h", "check").agg(*firsts).where("first < last").drop("last"), ["h", "check"])
    return heavy.unionByName(rest).where("first < ord").drop("first")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed (maximal
    removed word spans), kept_text (the other words joined by one blank).

    A word goes if it is covered by a window of 50 words that also starts in a row
    with a smaller id; windows are judged on the input.  Null ids count as the
    largest; rows sharing an id (all those without one, too) never remove each other's
    words and are judged each by its own.  Texts without words (null, empty, blank) and
    texts below 50 words lose nothing.

    Steps: (1) keys of whole word sequences: a copy of a smaller id's sequence loses
    all its words and is no reference; (2) the other texts' blocks fill a bitmap;
    (3) rolling probes that pass it are counted by hash, and blocks seen in two texts
    fill a second bitmap; (4) windows whose blocks are all in it, which are runs that
    grow from such anchors, meet by hash (see :func:`flagged`), one row per window and
    document; (5) flagged starts meet their texts by id and a hash of the words, and no
    other text is shuffled.  The bitmaps have fixed size and only spare work: what
    they let through is decided exactly.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("doc_id"), ordinal(F.col(id_col)).alias("ord"), F.col(text_col).cast("string").alias("text"))
    text = df.select("ord", "text")
    longs = lambda x: pa.array(np.concatenate([np.zeros(0, U), *x]).view(np.int64))
    flat = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(d) for d in _data(b)], pa.binary())], names=["ord", "digest"])

    def rowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_row(x) for x in b.column(1).to_pylist()], pa.int64())], names=["ord", "digest", "row"])

    whole = durable(text.mapInArrow(keys, "ord long, digest binary").where("digest is not null"), "sequences")
    first = durable(whole.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").drop("last"), "firsts")
    copies = whole.join(first, "digest").where("first < ord").select("ord", "digest").distinct()
    copies = durable(copies.mapInArrow(rowed, "ord long, digest binary, row long"), "copies")
    maybe_copy = spark.sparkContext.broadcast(Rows(copies))

    def among(rows, wanted: bool):
        """Rows that are in the set, or those that aren't."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                has = rows.value.has(b.column(b.schema.get_field_index("ord")).to_numpy(zero_copy_only=False), _data(b))
                yield b.filter(pa.array(has if wanted else ~has))

        return run

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the digest and row of each text."""
        for b in slices(batches):
            digest = [_digest(d) for d in _data(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digest, pa.binary()), pa.array([_row(x) for x in digest], pa.int64())], names=[*b.schema.names, "digest", "row"])

    # Texts that only seem to be copies are references too: found by key, so copies' texts stay where they are.
    picked = among(maybe_copy, True)
    keys_only = text.mapInArrow(tidy(lambda x: (b.drop_columns(["text"]) for b in keyed(picked(x)))), "ord long, digest binary, row long")
    false = durable(keys_only.join(copies, ["ord", "digest"], "left_anti").select("ord", "digest", "row").distinct(), "false")
    maybe_false = spark.sparkContext.broadcast(Rows(false))
    again = among(maybe_false, True)
    seeming = text.mapInArrow(tidy(lambda x: keyed(again(x))), "ord long, text string, digest binary, row long").join(false, ["ord", "digest"], "left_semi")
    seeming = durable(seeming.select("ord", "text"), "seeming")

    def reference(make, schema: str) -> DataFrame:
        """``make`` applied to ids and word hashes of all references that have a window."""

        def over(rows) -> object:
            @tidy
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in slices(batches):
                    ids, data = b.column(0).to_numpy(zero_copy_only=False), _data(b)
                    skip = rows.value.has(ids, data) if rows else np.zeros(len(ids), bool)
                    found = ((o, d, words(d, lower=False)) for o, d, x in zip(ids.tolist(), data, skip.tolist(), strict=True) if not x and len(d) >= 2 * WINDOW - 1)
                    yield make([(o, d, w) for o, d, w in found if len(w) >= WINDOW])

            return run

        return text.mapInArrow(over(maybe_copy), schema).unionByName(seeming.mapInArrow(over(None), schema))

    def blocks(found: list) -> pa.RecordBatch:
        return Bits.rows(np.concatenate([np.zeros(0, U), *(windows(w, BLOCK)[::BLOCK] for *_, w in found)]))

    indexed = spark.sparkContext.broadcast(Bits.gathered(reference(blocks, Bits.SCHEMA)))

    def probes(found: list) -> pa.RecordBatch:
        rolling = (windows(w, BLOCK) for *_, w in found)
        return pa.RecordBatch.from_arrays([longs([np.unique(h[indexed.value.has(h)]) for h in rolling])], names=["h"])

    twice = reference(probes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hit = spark.sparkContext.broadcast(Bits.of(twice))

    def grown(found: list) -> pa.RecordBatch:
        ids, rows, starts, one, two = [], [], [], [], []
        for o, d, w in found:
            # A repeated window's own blocks are repeated too: one that isn't rules it out.
            alone = np.zeros(len(w) - BLOCK + 1, np.int64)
            alone[::BLOCK] = ~hit.value.has(windows(w, BLOCK)[::BLOCK])
            total = np.cumsum(np.r_[0, alone])
            s = np.flatnonzero(total[WINDOW - BLOCK + 1 :] == total[: -(WINDOW - BLOCK + 1)])
            if len(s):
                h, first = np.unique(windows(w, WINDOW)[s], return_index=True)
                ids.append(np.full(len(h), o))
                rows.append(np.full(len(h), _row(_digest(d))))
                starts.append(s[first])
                one.append(h)
                two.append(_check(w)[s[first]])
        return pa.RecordBatch.from_arrays([longs(one), flat(two, np.int16), flat(ids, np.int64), flat(rows, np.int64), flat(starts, np.int32)], names=["h", "check", "ord", "row", "start"])

    seen = durable(reference(grown, "h long, check smallint, ord long, row long, start int"), "seen")
    # Per row: the flagged starts, or that its sequence is a copy as a whole.
    starts = flagged(seen).groupBy("ord", "row").agg(F.collect_set(F.struct("start", "check")).alias("starts"))
    decided = durable(starts.join(copies.withColumnRenamed("digest", "copy"), ["ord", "row"], "full"), "decided")
    touched = spark.sparkContext.broadcast(Rows(decided))
    release(whole, first, copies, false, seeming, seen)
    for x in (maybe_copy, maybe_false, indexed, hit):
        x.destroy()

    kind = df.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            n_words, n_removed, removed, kept = [], [], [], []
            for d, starts, copy in zip(_data(b), col("starts"), col("copy"), strict=True):
                w = d.split()
                flag = np.zeros(len(w), bool)
                if copy and copy == _digest(d):
                    flag[:] = True
                elif starts and len(w) >= WINDOW:
                    hashes = words(d, lower=False)
                    own, h = _check(hashes), windows(hashes, WINDOW)  # rows are told by hash: a start is taken if its window agrees
                    s = np.array([x["start"] for x in starts if x["start"] < len(own) and own[x["start"]] == x["check"]], np.int64)
                    flag = covered(len(w), np.flatnonzero(np.isin(h, h[s])))
                n_words.append(len(w))
                n_removed.append(int(flag.sum()))
                removed.append(runs(flag))
                kept.append(b" ".join([x for x, f in zip(w, flag.tolist(), strict=True) if not f] if n_removed[-1] else w))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
            )

    nothing = F.lit(None)
    clean = df.withColumns({"starts": nothing.cast(decided.schema["starts"].dataType), "copy": nothing.cast("binary")})
    found = among(touched, True)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    changed = df.mapInArrow(tidy(lambda x: keyed(found(x))), f"{fields}, digest binary, row long").join(decided, ["ord", "row"], "left").select(*clean.columns)
    untouched = among(touched, False)
    schema = f"doc_id {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    return clean.mapInArrow(tidy(lambda x: cut(untouched(x))), schema).unionByName(changed.mapInArrow(cut, schema))
