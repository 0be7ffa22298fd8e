"""Language of texts: a linear-chain conditional random field over their words.

A word's features are its prefixes and suffixes, its byte n-grams and the set of
languages whose sampled texts hold it (the lexicon).  Weights of features and
transitions are learned together on sequences in which the language switches;
forward-backward gives each word of a text a distribution over languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .audit import buffers
from .common import slices, tidy, unused

#: The learned rows: texts of each language at most, of all together, and bytes of one of them.
SAMPLE, TOTAL, LONGEST = 300, 4800, 64 << 10
#: Rows of the table of hashed features (a power of two), n-gram and affix lengths in bytes.
FEATURES, GRAMS, AFFIXES = 1 << 17, (1, 2, 3), (1, 2, 3, 4)
#: Training: words of a sequence, of a stretch in one language at least and at most, sequences of a step, rounds.
LENGTH, STRETCH, BATCH, EPOCHS = 120, (4, 60), 128, 3
#: Words whose matrices are multiplied in one row; rows run side by side.
CHUNK = 128
#: Bytes of text that a worker looks at together.
SLICE = 2 << 20
UNKNOWN = "und"
LEARNED_FOLDS, HELD_OUT = 4, 2

U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of letter bytes (ASCII letters, all bytes above)."""
    letter = np.append(_LETTER[data], False)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.append(False, letter[:-1])[: len(data)]
    start = np.flatnonzero(letter[:-1] & (~before | edge[:-1]))
    end = np.flatnonzero(letter[:-1] & (~letter[1:] | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (hashing.mix(h) & U(FEATURES - 1)).astype(np.int64)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], word: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, feature) of the given spans: n-grams, affixes, lexicon entry and a constant.

    ``lexicon`` holds sorted word hashes and a hash of each one's set of languages;
    words that ``known`` leaves out get the entry of unknown words.
    """
    size = end - start
    n = len(start)
    owner = np.repeat(np.arange(n), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    b = data[start[owner] + inside].astype(U)
    left = size[owner] - inside
    words, found = [np.arange(n)], [np.zeros(n, np.int64)]
    h = np.zeros(len(b), U)
    for k in range(max(GRAMS)):
        h = h[: len(b) - k] * U(257) + b[k:] + U(1) if k else b + U(1)
        if k + 1 in GRAMS:
            fits = left[: len(h)] > k
            words.append(owner[: len(h)][fits])
            found.append(_bucket(h[fits] * U(8) + U(k)))
    for k in AFFIXES:
        long = np.flatnonzero(size >= k)
        for side, first in ((1, start[long]), (2, end[long] - k)):
            h = np.zeros(len(long), U)
            for j in range(k):
                h = h * U(257) + data[first + j].astype(U) + U(1)
            words.append(long)
            found.append(_bucket((h * U(8) + U(k)) * U(4) + U(side)))
    keys, sets = lexicon
    entry = np.zeros(n, U)
    if len(keys):
        spot = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
        hit = keys[spot] == word
        entry[hit] = sets[spot[hit]]
    if known is not None:
        entry[~known] = 0
    words.append(np.arange(n))
    found.append(_bucket(entry + U(77)))
    return np.concatenate(words), np.concatenate(found)


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # [FEATURES, labels]
    moves: np.ndarray  # [labels, labels], log potentials of going from one to the other
    begin: np.ndarray  # [labels]
    lexicon: tuple[np.ndarray, np.ndarray]

    def scores(self, data, start, end, word) -> np.ndarray:
        """Log potentials [words, labels] of the features of each word."""
        owner, found = features(data, start, end, self.lexicon, word)
        out = np.empty((len(start), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owner, self.weights[found, k], len(start))
        return out

    def marginals(self, scores: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Distribution of each word's label by forward-backward; ``opens`` marks the
        first words of texts, where the chain begins anew.

        The words of all texts are one chain cut into rows of CHUNK words.  The matrices of
        each row are multiplied for all rows side by side, messages pass from row to row,
        and the rows are run again from the messages they get: the result is exact.
        """
        n, k = scores.shape
        rows = -(-n // CHUNK)
        psi = np.ones((rows * CHUNK, k))
        psi[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
        psi = psi.reshape(rows, CHUNK, k).transpose(1, 0, 2).copy()
        new = np.ones(rows * CHUNK, bool)
        new[:n] = opens
        new = new.reshape(rows, CHUNK).T.copy()
        move, begin = np.exp(self.moves), np.exp(self.begin)

        def forward(x: np.ndarray, t: int) -> np.ndarray:  # [..., rows, k] from word t - 1 to t
            y = x @ move
            fresh = new[t]
            if fresh.any():
                y[..., fresh, :] = x[..., fresh, :].sum(axis=-1, keepdims=True) * begin
            return y * psi[t]

        def backward(x: np.ndarray, t: int) -> np.ndarray:  # from word t to t - 1
            x = x * psi[t]
            y = x @ move.T
            fresh = new[t]
            if fresh.any():
                y[fresh] = (x[fresh] @ begin)[:, None]
            return y

        whole = np.broadcast_to(np.eye(k)[:, None], (k, rows, k)).copy()
        for t in range(CHUNK):
            whole = forward(whole, t)
            if t % 16 == 15:
                whole /= np.maximum(whole.max(axis=(0, 2), keepdims=True), 1e-300)
        ahead, back = np.empty((rows, k)), np.empty((rows, k))
        a, b = np.full(k, 1 / k), np.full(k, 1 / k)
        for r in range(rows):
            ahead[r] = a
            a = a @ whole[:, r]
            a = a / max(a.sum(), 1e-300)
        for r in range(rows - 1, -1, -1):
            back[r] = b
            b = whole[:, r] @ b
            b = b / max(b.sum(), 1e-300)
        alpha = np.empty((CHUNK, rows, k))
        x = ahead
        for t in range(CHUNK):
            x = forward(x, t)
            x /= np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
            alpha[t] = x
        x = back
        for t in range(CHUNK - 1, -1, -1):
            alpha[t] *= x
            x = backward(x, t)
            x /= np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
        out = alpha.transpose(1, 0, 2).reshape(rows * CHUNK, k)[:n]
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, row and distribution of each word of several texts."""
        data = _FOLD[data]
        start, end, row = word_spans(data, at)
        if not len(start):
            return start, end, row, np.zeros((0, len(self.labels)))
        word = hashing.hashed(data, start, end)
        _, one, back = np.unique(word, return_index=True, return_inverse=True)
        scores = self.scores(data, start[one], end[one], word[one])[back]
        return start, end, row, self.marginals(scores, np.append(True, row[1:] != row[:-1]))


def make_lexicon(word: np.ndarray, label: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that stand twice in the learned texts, and of their sets of languages."""
    keys, back, count = np.unique(word, return_inverse=True, return_counts=True)
    marks = np.random.default_rng(5).integers(1, 2**63, max(labels, 1), dtype=U)
    pairs = np.unique(np.stack([back, label]), axis=1)
    sets = np.zeros(len(keys), U)
    np.bitwise_xor.at(sets, pairs[0], marks[pairs[1]])
    return keys[count > 1], sets[count > 1]


def fit(texts: list[bytes], langs: list[str], seed: int = 1) -> Field:
    """AdaGrad on the conditional log-likelihood of label sequences.

    Each text is one language; sequences are stretches of different texts joined, so
    transitions are learned where the language changes.  A word's lexicon entry is hidden
    in half of the steps, or it would stand for the other features.
    """
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    field = Field(labels, np.zeros((FEATURES, max(k, 1))), np.zeros((k, k)), np.zeros(k), (np.zeros(0, U), np.zeros(0, U)))
    data = _FOLD[np.frombuffer(b" ".join(texts), np.uint8)] if texts else np.zeros(0, np.uint8)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    at[-1] = len(data)
    start, end, row = word_spans(data, at)
    if k < 2 or not len(start):
        return field
    word = hashing.hashed(data, start, end)
    label = np.array([labels.index(x) for x in langs])[row]
    field.lexicon = make_lexicon(word, label, k)
    _, one, back = np.unique(word, return_index=True, return_inverse=True)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    step_w, step_m, step_b = np.full_like(field.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    for epoch in range(EPOCHS):
        cuts: list = []
        for d in range(len(texts)):
            i = first[d]
            while i < first[d + 1]:
                j = min(i + int(rng.integers(*STRETCH)), first[d + 1])
                cuts.append(np.arange(i, j))
                i = j
        rng.shuffle(cuts)
        order = np.concatenate(cuts)
        order = np.resize(order, (max(1, len(order) // LENGTH), LENGTH))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            used, local = np.unique(back[part], return_inverse=True)
            local = local.reshape(part.shape)
            spot = one[used]
            owner, found = features(data, start[spot], end[spot], field.lexicon, word[spot], rng.random(len(used)) < 0.5)
            scores = np.stack([np.bincount(owner, field.weights[found, c], len(used)) for c in range(k)], axis=1)
            e, y, rows = scores[local], label[part], len(part)
            psi, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(field.moves)
            alpha, beta = np.empty_like(psi), np.empty_like(psi)
            x = np.exp(field.begin) * psi[:, 0]
            for t in range(LENGTH):
                x = (x if t == 0 else (x @ move) * psi[:, t])
                x = x / x.sum(axis=1, keepdims=True)
                alpha[:, t] = x
            x = np.ones((rows, k))
            expected = np.zeros((k, k))
            for t in range(LENGTH - 1, -1, -1):
                beta[:, t] = x
                if t:
                    flow = psi[:, t] * x
                    pair = alpha[:, t - 1, :, None] * move * flow[:, None]
                    expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                    x = flow @ move.T
                    x = x / x.sum(axis=1, keepdims=True)
            p = alpha * beta
            p /= p.sum(axis=2, keepdims=True)
            gap = -p
            np.put_along_axis(gap, y[..., None], np.take_along_axis(gap, y[..., None], 2) + 1, 2)
            by_word = np.stack([np.bincount(local.ravel(), gap[..., c].ravel(), len(used)) for c in range(k)], axis=1)
            grad = np.stack([np.bincount(found, by_word[owner, c], FEATURES) for c in range(k)], axis=1) / rows - 1e-5 * field.weights
            seen = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            for value, g, total in ((field.weights, grad, step_w), (field.moves, (seen - expected) / rows, step_m), (field.begin, gap[:, 0].sum(axis=0) / rows, step_b)):
                total += g * g
                value += (0.3 if value is field.weights else 0.2) * g / np.sqrt(total)
    return field


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % LEARNED_FOLDS == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, lang_col: str, text_col: str, sample: int) -> list[tuple[str, str]]:
    """(text, lang) of at most ``sample`` rows of each language outside the held-out
    fold, TOTAL at most, in the order of a hash of their ids.

    Only ids are ranked, each partition keeping its best ones; the chosen ones are
    broadcast to pick the texts.  Texts of more than LONGEST bytes aren't learned from.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~fold(F.col("id")) & (F.octet_length("text") <= LONGEST))
    langs = rows.select("lang").distinct().count()
    size = min(sample, max(1, TOTAL // max(langs, 1)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("id", "lang").distinct()
    got = rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).toArrow().to_pylist()
    return sorted((r["text"], r["lang"]) for r in got)


def predict(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32(id) mod 4 is 2), lang_pred, score,
    n_words and n_switches (words labelled, changes of label between neighbours).

    The field learns from text and lang of a bounded sample (``sample`` rows of each
    language) outside the held-out fold; rows without id or lang aren't learned from.
    Predictions read whole texts and nothing else: lang_pred has the largest mean
    probability over the text's words (ties: the first by name), and that is the score.
    Null, empty and letterless texts are ``und`` with score 0, as is every text where
    no language can be learned; with one language all others are that one.  Null ids are
    never held out.  One narrow pass after the fit, no shuffle of texts.
    """
    rows = training_sample(docs, id_col, lang_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(fit([t.encode() for t, _ in rows], [x for _, x in rows]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        names, k = np.array([*field.labels, UNKNOWN], object), len(field.labels)
        for b in slices(batches, limit=SLICE):
            at, data = buffers(b.column(2))
            n = b.num_rows
            label, score, words, switches = np.full(n, k), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if k:
                _, _, row, p = field.words(data, at)
                words = np.bincount(row, minlength=n)
                mean = np.stack([np.bincount(row, p[:, c], n) for c in range(k)], axis=1) / np.maximum(words, 1)[:, None]
                best = p.argmax(axis=1)
                turn = (best[1:] != best[:-1]) & (row[1:] == row[:-1])
                switches = np.bincount(row[1:][turn], minlength=n)
                lettered = b.column(3).to_numpy(zero_copy_only=False) & (words > 0)
                label = np.where(lettered, mean.argmax(axis=1), k)
                score = np.where(lettered, np.minimum(mean.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[label], pa.string()), pa.array(score), pa.array(words), pa.array(switches)], names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(id_col)).alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_words long, n_switches long")


def labelled(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` with ``spans``: the stretches of words of one language of
    each text (lang, first and end byte, mean probability), in order."""
    rows = training_sample(docs, id_col, lang_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(fit([t.encode() for t, _ in rows], [x for _, x in rows]))
    name, copy = unused(docs, "spans"), unused(docs, "whole")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in slices(batches, copy, SLICE):
            spot = b.schema.get_field_index(copy)
            at, data = buffers(b.column(spot))
            out: list[list] = [[] for _ in range(b.num_rows)]
            if field.labels:
                start, end, row, p = field.words(data, at)
                best = p.argmax(axis=1)
                turns = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                for i, j in zip(turns, np.append(turns[1:], len(row)), strict=True):
                    r = row[i]
                    out[r].append({"lang": field.labels[best[i]], "first": int(start[i] - at[r]), "end": int(end[j - 1] - at[r]), "probability": float(p[i:j, best[i]].mean())})
            yield b.set_column(spot, pa.field(name, kind), pa.array(out, kind))

    df = docs.withColumn(copy, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    schema = docs.select("*", F.array().cast("array<struct<lang:string,first:long,end:long,probability:double>>").alias(name)).schema
    return df.mapInArrow(run, schema)
