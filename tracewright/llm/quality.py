"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters look at WIDTH bytes every STRIDE bytes, so windows overlap and
every byte of a text is seen.  Responses are max-pooled over chunks that overlap
by half, each chunk gets a logit, and mean and extreme chunks combine into one
probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, tidy

WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 2, 24, 8
#: Bytes of text that a worker looks at together.
SLICE = 2 << 20
#: Windows of half a chunk; a chunk is two halves, the next starts one half on.
HALF = 64
#: Labelled texts of each class that the fit may take (the bounded sample), and rounds over them.
SAMPLE, EPOCHS, BATCH = 700, 12, 24
#: Bytes of labelled texts that the fit may take.
BUDGET = 256 << 20


@dataclass
class Network:
    embed: np.ndarray  # [256, EMBEDDING]
    filters: np.ndarray  # [WIDTH, EMBEDDING, FILTERS]
    bias: np.ndarray  # [FILTERS]
    slope: np.ndarray  # [FILTERS]: how far a short chunk's maxima lie below a full one's
    head: np.ndarray  # [FILTERS + 1], the last is a constant
    mix: np.ndarray  # weights of mean, least and greatest chunk logit, and a constant

    def tables(self) -> np.ndarray:
        """Response of each filter tap to each byte: convolution by lookup."""
        return np.einsum("be,wek->wbk", self.embed, self.filters).astype(np.float32)

    def pooled(self, data: bytes, tables: np.ndarray, winners: bool = False):
        """Chunk features [chunks, FILTERS], and if asked the winning windows."""
        b = np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8)
        if rest := (len(b) - WIDTH) % STRIDE:
            b = np.append(b, np.zeros(STRIDE - rest, np.uint8))
        n = (len(b) - WIDTH) // STRIDE + 1
        z = tables[0][b[0 : n * STRIDE : STRIDE]]
        for j in range(1, WIDTH):
            z += tables[j][b[j : j + n * STRIDE : STRIDE]]
        halves = np.arange(0, n, HALF)
        top = np.maximum.reduceat(z, halves, axis=0)
        size = np.diff(np.append(halves, n))
        size = np.log(2 * HALF / (size[:-1] + size[1:] if len(size) > 1 else size))[:, None]
        if not winners:
            return (np.maximum(top[:-1], top[1:]) if len(top) > 1 else top), size
        at = np.stack([s + np.argmax(z[s : s + HALF], axis=0) for s in halves])
        if len(top) > 1:
            at = np.where(top[1:] > top[:-1], at[1:], at[:-1])
            top = np.maximum(top[:-1], top[1:])
        return top, size, at, b

    def chunk_logits(self, top: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(top + self.bias + self.slope * size)
        return h @ self.head[:-1] + self.head[-1], h

    def logit(self, data: bytes, tables: np.ndarray) -> float:
        c, _ = self.chunk_logits(*self.pooled(data, tables))
        return float(self.mix @ [c.mean(), c.min(), c.max(), 1.0])


def fit(texts: list[bytes], labels: list[int], prior: float, seed: int = 3) -> Network:
    """Adam on the logistic loss; ``prior`` is the share of label 1 to answer for.

    Without both labels the result is constant at the prior.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, EMBEDDING)), rng.normal(0, 0.35, (WIDTH, EMBEDDING, FILTERS)), np.zeros(FILTERS), np.full(FILTERS, 0.3), rng.normal(0, 0.1, FILTERS + 1), np.array([0.5, 0.25, 0.25, 0.0]))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    shift = np.log(prior / (1 - prior))
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        net.mix[:] = [0, 0, 0, shift]
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ["embed", "filters", "bias", "slope", "head", "mix"]
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    t = 0
    taps = np.arange(WIDTH)
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            tables = net.tables()
            grad = {k: np.zeros_like(getattr(net, k)) for k in names}
            codes, flows = [], []
            for i in part:
                top, size, at, b = net.pooled(texts[i], tables, winners=True)
                c, h = net.chunk_logits(top, size)
                lo, hi = int(c.argmin()), int(c.argmax())
                x = np.array([c.mean(), c[lo], c[hi], 1.0])
                p = 1 / (1 + np.exp(-np.clip(net.mix @ x, -30, 30)))
                d = (p - y[i]) * weight[i] / len(part)
                grad["mix"] += d * x
                dc = np.full(len(c), d * net.mix[0] / len(c))
                dc[lo] += d * net.mix[1]
                dc[hi] += d * net.mix[2]
                grad["head"][:-1] += dc @ h
                grad["head"][-1] += dc.sum()
                dz = dc[:, None] * net.head[:-1] * (1 - h * h)
                grad["bias"] += dz.sum(axis=0)
                grad["slope"] += (dz * size).sum(axis=0)
                byte = b[(at * STRIDE)[None] + taps[:, None, None]]  # [WIDTH, chunks, FILTERS]
                codes.append(((taps[:, None, None] * 256 + byte) * FILTERS + np.arange(FILTERS)).ravel())
                flows.append(np.broadcast_to(dz, byte.shape).ravel())
            dt = np.bincount(np.concatenate(codes), np.concatenate(flows), WIDTH * 256 * FILTERS).reshape(WIDTH, 256, FILTERS)
            grad["embed"] = np.einsum("wbk,wek->be", dt, net.filters)
            grad["filters"] = np.einsum("be,wbk->wek", net.embed, dt)
            t += 1
            for k in names:
                g = grad[k] + 1e-4 * getattr(net, k)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
    net.mix[-1] += shift
    return net


def training_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> tuple[list, float]:
    """At most ``size`` labelled texts of each class outside the held-out fold, in
    the order of a hash of their ids, and the share of label 1 among all of them.

    Only ids are ranked; the at most 2 * size chosen ones are broadcast to pick the
    texts.  A repeated id counts once, with its least text.  ``budget`` bounds the
    bytes that go to the driver: texts beyond their even share of it are left out.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).dropDuplicates(["id"])
    share = known.agg(F.avg("y")).first()[0]
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(size)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= budget // (2 * size))
    rows = texts.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    return [(r["text"], r["y"]) for r in rows], 0.5 if share is None else share


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (fold 1 of crc32(id) mod 3), score.

    The network learns from ``labels`` (doc_id, quality) outside the held-out fold,
    from at most ``sample`` texts of each label; label, lang, source and id are no
    inputs of a score.  Whole texts are scored.  Null and empty texts get the score
    of an empty window; null ids are never held out; without usable labels all
    scores are the prior.  One narrow pass over the documents, no shuffle of texts.
    """
    rows, share = training_sample(docs, labels, "quality", sample, id_col, text_col)
    net = docs.sparkSession.sparkContext.broadcast(fit([t.encode() for t, _ in rows], [y for _, y in rows], share))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.value.tables()
        for b in slices(batches, limit=SLICE):
            x = np.array([net.value.logit((t or "").encode(), tables) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=["doc_id", "held_out", "score"])

    df = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged) with a score of at least 0.5.

    Texts are scored where they are: the verdict travels with the row, nothing is
    joined, so repeated and null ids need no care.
    """
    rows, share = training_sample(docs, labels, "quality", sample)
    net = docs.sparkSession.sparkContext.broadcast(fit([t.encode() for t, _ in rows], [y for _, y in rows], share))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.value.tables()
        for b in slices(batches, limit=SLICE):
            at = b.schema.get_field_index("text")
            yield b.filter(pa.array([net.value.logit((t or "").encode(), tables) >= 0 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
