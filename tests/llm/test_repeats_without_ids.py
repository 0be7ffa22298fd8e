"""Repeats among rows without ids or with one id, and windows that most rows have."""

import random
import re

import pytest

from tracewright.llm import substrings

SCHEMA = "doc_id long, text string, row long, h long, digest string"


def brute(rows, k=50):
    """Words kept of each row; null ids are the largest, equal ids never judge each other."""
    cut = [(10**18 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for o, w in cut:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, o), o)
    out = []
    for (i, _), (o, w) in zip(rows, cut, strict=True):
        gone = {p for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < o for p in range(s, s + k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def answers(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "d") for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("ident", [None, 7])
def test_rows_of_one_id_are_judged_each_by_its_own(spark, ident):
    rng = random.Random(1)
    unique = lambda n: " ".join(f"u{rng.random()}" for _ in range(n))
    passages = [" ".join(f"p{k}_{j}" for j in range(60)) for k in range(5)]
    rows = [(k, f"{p} {unique(20)}") for k, p in enumerate(passages)]
    rows += [(ident, f"{unique(rng.randrange(60))} {rng.choice(passages)} {unique(30)}") for _ in range(300)]
    rows += [(ident, unique(rng.randrange(60, 120))) for _ in range(300)]
    rows += [(ident, rows[0][1]), (ident, rows[0][1]), (ident, None), (ident, "")]
    got = answers(spark, rows)
    assert got == brute(rows)
    assert sum(n > 0 for _, _, n, _ in got) == 302


def test_windows_that_most_rows_have(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 16)
    monkeypatch.setattr(substrings.frequent, "__defaults__", (16,))
    monkeypatch.setattr(substrings, "GATHERED", 500)
    rng = random.Random(2)
    notice = " ".join(f"n{j}" for j in range(54))
    rare = [" ".join(f"r{k}_{j}" for j in range(70)) for k in range(20)]
    rows = []
    for i in range(400):
        parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))]
        parts += [notice] if rng.random() < 0.7 else []
        parts += [rng.choice(rare)] if rng.random() < 0.2 else []
        rng.shuffle(parts)
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(parts)))
    assert answers(spark, rows) == brute(rows)


def test_bitmaps_travel_whole():
    import pickle

    import numpy as np

    from tracewright.llm.common import Bits

    for filled in (0, 5, 1000, 1 << 20, (1 << 21) - 1):
        words = np.zeros(1 << 21, np.uint64)
        words[:filled] = np.arange(1, filled + 1, dtype=np.uint64)
        data = pickle.dumps(Bits(words))
        assert (pickle.loads(data).words == words).all()
        assert len(data) < (12 * filled if filled < 1 << 20 else 8 << 21) + 1000
