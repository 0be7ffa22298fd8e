"""SentencePiece encoding and decoding over a table of distinct chunks.

If no piece has a white-space marker behind another character, a merge can
never cross into the next marked word.  So each distinct chunk (a run of
markers and the word behind it) is segmented once, and a text's ids are its
chunks' ids joined by position.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, tidy

MARK = "▁"
#: Bytes of distinct chunks, and of what belongs to them, that a worker remembers before it starts afresh.
REMEMBERED = 48 << 20
#: Bytes that a chunk takes besides its own and its ids', and the longest one that is remembered.
OVERHEAD, LONGEST = 200, 200
#: Bytes of text that are looked at together, also of one longer text.
SLICE = 1 << 20


def crossing_pieces(model) -> list[str]:
    """Pieces with a marker behind another character; the method needs none."""
    return [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)]


def split(text: str) -> list[str]:
    """Chunks of a non-empty text, each without its first marker."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, blank = [], 0
    for p in parts:
        if p:
            out.append(" " * blank + p)
            blank = 0
        else:
            blank += 1
    if blank:
        out.append(" " * (blank - 1))
    return out


def segments(text: str, size: int = SLICE) -> Iterator[str]:
    """A text cut before words (at the first of the blanks there), so that the
    segments' chunks are the text's chunks."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder of one model, for lists of whole texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if crossing := crossing_pieces(m):
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        self.surface = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        self.begin, self.end = (pack([i]) for i in (m.bos_id(), m.eos_id()))
        self.forget()

    def forget(self) -> None:
        #: Ids of each distinct chunk, and the text of the chunks that don't decode to themselves.
        self.ids: dict[str, bytes] = {"": pack([self.model.piece_to_id(MARK)])}
        self.odd: dict[str, bytes] = {}
        self.size = 0

    def learn(self, chunks: set[str]) -> list[str]:
        """Segment the new chunks; returns those too long to be remembered."""
        new = [c for c in chunks if c not in self.ids]
        surface = self.surface.__getitem__
        for c, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.ids[c] = pack(ids)
            self.size += OVERHEAD + 5 * len(c)
            if (text := b"".join(map(surface, ids))) != b" " + c.encode():
                self.odd[c] = text
        return [c for c in new if len(c) > LONGEST]

    def code(self, cut: list[list[str]]) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of each list of chunks."""
        if self.size > REMEMBERED:
            self.forget()
        long = self.learn(set().union(*cut))
        get, out = self.ids.__getitem__, []
        for parts in cut:
            if self.odd and not self.odd.keys().isdisjoint(parts):
                text = b"".join([self.odd.get(c, b" " + c.encode()) for c in parts])[1:].decode()
            else:
                text = " ".join(parts)
            out.append((b"".join(map(get, parts)), text))
        for c in long:
            self.size -= OVERHEAD + 5 * len(c)
            del self.ids[c]
            self.odd.pop(c, None)
        return out

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids with begin and end, packed as little-endian
        unsigned 32-bit integers, and what they decode to."""
        plain = [t.replace(MARK, " ") for t in texts]
        if sum(map(len, plain)) <= SLICE:
            coded = self.code([split(t) if t else [] for t in plain])
        else:
            coded = []
            for t in plain:
                got = [self.code([split(x)])[0] for x in segments(t)] if t else [(b"", "")]
                coded.append((b"".join([ids for ids, _ in got]), " ".join([x for _, x in got])))
        return [(b"".join([self.begin, ids, self.end]), text) for ids, text in coded]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """A worker keeps its codec from one task to the next, but not its table."""
    return Codec(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian u32, with
    begin and end), decoded (string).

    Null and empty texts give begin and end alone and decode to ''.  Ids may be
    null or repeat; other columns are ignored.  ``model_path`` is a file that every
    executor has.  One narrow pass, no shuffle; a worker's table of chunks is bounded
    in bytes and goes with its task; long texts are coded in segments.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_codec = codec(model_path)
        for b in slices(batches, limit=SLICE):
            got = run_codec(texts(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.string())], names=["doc_id", "ids", "decoded"])
        run_codec.forget()

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
