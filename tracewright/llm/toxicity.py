"""Toxicity of texts whose spelling may be disguised.

A noisy channel turns letters into look-alikes, puts marks or blanks between
them, or repeats them.  For words that look disguised a lattice of possible
letters is decoded by Viterbi under a character language model of the whole
corpus; plain and restored words together are scored by what labelled texts
taught about words and word beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices
from .quality import training_sample

#: Letters that a sign can stand for (fixed values).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "*": "aeiou", "%": "o",
}
#: Natural-log costs of the channel: a look-alike, a letter written more than once.
SWAP, REPEAT = 1.0, 0.7
#: Labelled texts of each class that the fit may take (the bounded sample).
SAMPLE = 2500
#: Word beginnings that count as features, and the least support of a feature.
PREFIXES, SUPPORT = (4, 5), 3
#: Characters of runs that a worker remembers.
REMEMBERED = 4_000_000
#: Bytes of text that a worker looks at together.
SLICE = 1 << 20
#: Strength with which the scale is held to its first value.
RIDGE = np.array([20.0, 20.0, 0.5])

_LETTER = "abcdefghijklmnopqrstuvwxyzß-öø-ÿ"
_SIGN = re.escape("".join(LOOKS))
_WORD = re.compile(f"[{_LETTER}]+")
_SPACED = re.compile(rf"(?<![{_LETTER}0-9@$])(?:[{_LETTER}{_SIGN}]([ .\-_*/])(?:[{_LETTER}{_SIGN}]\1)+[{_LETTER}{_SIGN}])(?![{_LETTER}0-9@$])")
_MIXED = re.compile(rf"(?<![{_LETTER}{_SIGN}])(?=[{_SIGN}]*[{_LETTER}])(?=[{_LETTER}]*[{_SIGN}])[{_LETTER}{_SIGN}]{{3,}}")
_LONG = re.compile(rf"([{_LETTER}])\1\1")
_MANY = re.compile(r"(.)\1{3,}", re.DOTALL)

#: Symbols of the language model: 0 is a word's edge, 1-26 the letters, 27 any other letter.
SYMBOLS = 28
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27


def trigrams(data: bytes) -> np.ndarray:
    """Counts of letter triples, words padded by their edges (continuation bytes
    of other letters are dropped first, so each such letter is one symbol)."""
    b = np.frombuffer(data, np.uint8)
    c = _CODE[b[(b & 0xC0) != 0x80]]
    c = np.concatenate([[0, 0], c, [0, 0]])
    return np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


class LanguageModel:
    """Letter trigrams, smoothed by bigrams and unigrams, as negative logs."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float).copy()
        three[0, 0, 0] = 0
        two, one = three.sum(axis=0), three.sum(axis=(0, 1)) + 1
        p = one / one.sum()
        p = (two + 8 * p) / (two.sum(axis=1, keepdims=True) + 8)
        p = (three + 8 * p[None]) / (three.sum(axis=2, keepdims=True) + 8)
        self.cost = -np.log(p)
        self.table = self.cost.tolist()

    def decode(self, signs: str, spaced: bool = False) -> str:
        """Cheapest word of a lattice: each run of one sign is one of its letters, once or twice.

        With ``spaced``, edges of words may stand between any two letters; they are
        blanks of the result.  Time is linear in the signs.
        """
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", signs, re.DOTALL)]
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the last two symbols decide what follows
        for sign, n in runs:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter in LOOKS.get(sign, sign):
                s, swap = symbol(letter), SWAP if sign in LOOKS else 0.0
                forms = [letter, letter * 2] if n > 1 else [letter]
                if spaced:
                    forms += [f"{letter} {letter}"] * (n > 1)
                    forms += [f" {f}" for f in forms]
                for form in forms:
                    codes = [0 if c == " " else s for c in form]
                    extra = swap * n + REPEAT * (n != form.count(letter))
                    for (a, b), (cost, back) in paths.items():
                        if codes[0] == b == 0:
                            continue
                        c, x, y = cost + extra, a, b
                        for code in codes:
                            c += self.table[x][y][code]
                            x, y = y, code
                        if (x, y) not in new or c < new[x, y][0]:
                            new[x, y] = (c, (back, form))
            paths = new
        _, back = min(((c + self.table[a][b][0], w) for (a, b), (c, w) in paths.items()), key=lambda x: x[0])
        found = []
        while back:
            back, form = back
            found.append(form)
        return "".join(reversed(found))


def disguised(lower: str) -> Iterator[tuple[str, bool]]:
    """Runs of signs of a lower-cased text that may hide words, whole, and whether
    all letters of the run stood apart (then it may hide several)."""
    for m in _SPACED.finditer(lower):
        yield m[0][::2], True
    for m in _MIXED.finditer(lower):
        yield m[0], False
        if (bare := m[0].strip("!|(<#*%+")) != m[0] and len(bare) > 2:
            yield bare, False
    if _LONG.search(lower):
        for m in _WORD.finditer(lower):
            if _LONG.search(m[0]):
                yield m[0], False


@dataclass
class Restorer:
    lm: LanguageModel
    memory: dict = field(default_factory=dict)
    size: int = 0

    def __call__(self, lower: str) -> set[str]:
        out = set()
        for signs, spaced in disguised(lower):
            key = _MANY.sub(r"\1\1\1", signs), spaced  # more of a sign cost the same on every path
            if key not in self.memory:
                if self.size > REMEMBERED:
                    self.memory.clear()
                    self.size = 0
                self.memory[key] = self.lm.decode(*key).split()
                self.size += len(key[0])
            out.update(self.memory[key])
        return out


def features(text: str, restore: Restorer) -> tuple[set[str], set[str]]:
    """Words, plain and restored, and their beginnings (marked by a hyphen); and the restored words."""
    lower = text.lower()
    words = set(lower.split())
    words |= {w.strip(".,;:!?\"'()[]") for w in words} if not lower.isascii() or any(c in lower for c in ".,;:!?\"'()[]") else set()
    restored = restore(lower)
    words |= restored
    out = set(words)
    for k in PREFIXES:
        out |= {w[:k] + "-" for w in words if len(w) > k}
    return out, restored


@dataclass
class Scorer:
    weight: dict[str, float]
    scale: np.ndarray  # of the greatest weight, the rest, and a constant

    def logit(self, found: set[str]) -> float:
        hits = sorted((self.weight[f] for f in found & self.weight.keys()), reverse=True)
        return float(self.scale @ [hits[0] if hits else 0.0, min(sum(hits[1:4]), 12.0), 1.0])


def learn(sets: list[set[str]], labels: list[int], share: float) -> Scorer:
    """Features that speak for toxicity, their log-odds, and a logistic scale on top.

    Weights come from one half of the texts and the scale from the other, so that
    chance features don't look better than they are; then weights take all texts.
    """

    def weights(chosen: list[int]) -> dict[str, float]:
        counts = {0: Counter(), 1: Counter()}
        for i in chosen:
            counts[labels[i]].update(sets[i])
        n = {y: max(1, sum(labels[i] == y for i in chosen)) for y in (0, 1)}
        odds = {f: np.log((c + 0.5) / (n[1] + 1)) - np.log((counts[0][f] + 0.5) / (n[0] + 1)) for f, c in counts[1].items() if c >= SUPPORT}
        return {f: float(w) for f, w in odds.items() if w > 2.0}

    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        return Scorer({}, np.array([0.0, 0.0, prior]))
    order = sorted(range(len(sets)), key=lambda i: labels[i])
    half, rest = weights(order[::2]), order[1::2]
    one = Scorer(half, np.array([1.0, 0.0, 0.0])), Scorer(half, np.array([0.0, 1.0, 0.0]))
    x = np.array([[s.logit(sets[i]) for s in one] + [1.0] for i in rest])
    y = np.array([labels[i] for i in rest], float)
    # As in the corpus: each class counts by its share.
    w = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    first = np.array([1.0, 0.35, -6.5])  # where few labels leave the scale open
    scale = first.copy()
    for _ in range(30):  # Newton steps with a ridge towards that
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        g = x.T @ (w * (p - y)) + RIDGE * (scale - first)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(RIDGE)
        scale = scale - np.linalg.solve(h, g)
    return Scorer(weights(list(range(len(sets)))), scale)


def corpus_model(docs: DataFrame, text_col: str = "text") -> LanguageModel:
    """Letter trigrams counted over every text (one row per triple and partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in slices(batches):
            total += trigrams(b" ".join((t or "").encode() for t in b.column(0).to_pylist()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["triple", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return LanguageModel(counts)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (fold 1 of crc32(id) mod 3),
    score, restored (words decoded from disguise, sorted).

    The language model counts all texts; weights come from ``labels`` (doc_id,
    toxic) outside the held-out fold, from at most ``sample`` texts of each label.
    Label, lang, source and id are no inputs of a score.  Null and empty texts have
    no features and get the base score; null ids are never held out; without usable
    labels all scores are the prior.  Two narrow passes, no shuffle of texts.
    """
    spark = docs.sparkSession
    lm = corpus_model(docs, text_col)
    rows, share = training_sample(docs, labels, "toxic", sample, id_col, text_col)
    restore = Restorer(lm)
    model = spark.sparkContext.broadcast((lm, learn([features(t, restore)[0] for t, _ in rows], [y for _, y in rows], share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, scorer = model.value
        restore = Restorer(lm)
        for b in slices(batches, limit=SLICE):
            lists = [t or "" for t in b.column(2).to_pylist()]
            told = [features(t, restore) for t in lists]
            x = np.array([scorer.logit(found) for found, _ in told])
            restored = [sorted(words) for _, words in told]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.array(restored, pa.list_(pa.string()))], names=["doc_id", "held_out", "score", "restored"])

    df = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, restored array<string>")
