"""Families whose members carry the same edits: right components, rows met in proportion."""

import random
import re

import pytest

from tracewright.llm import ngram_join

SCHEMA = "doc_id long, text string"


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def brute(rows, k, percent):
    s = {i: sets(t, k) for i, t in rows}
    up = {i: i for i in s}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(s[a] & s[b])
            if s[a] and s[b] and 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def met(spark, monkeypatch, rows, k=4, percent=85):
    counts, kept = {}, ngram_join.durable

    def counted(df, tag):
        out = kept(df, tag)
        counts[tag] = counts.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "durable", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), k, percent).collect()}
    monkeypatch.undo()
    return got, counts


def template(n, shared=40, own=1, seed=0):
    """One document, and n copies that carry the same words more and some of their own."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        words = [*base[:100], *(f"s{j}" for j in range(shared)), *base[100:]]
        for j in range(own):
            words.insert(rng.randrange(len(words)), f"own{i}_{j}")
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("n", [250, 500])
def test_copies_of_a_template_meet_in_proportion(spark, monkeypatch, n):
    got, counts = met(spark, monkeypatch, template(n))
    assert got == {0: 0} | dict.fromkeys(range(1, n + 1), 1)
    assert counts["star"] + counts["met"] + counts.get("open", 0) <= 4 * n, counts


def test_two_large_families_of_one_kind(spark, monkeypatch):
    # linked to the base by 30 words more, unlinked by 45: both carry the same 30
    n, base = 120, [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2 * n + 1):
        extra = [f"s{j}" for j in range(24 if i % 2 else 44)]
        words = [*base[:100], *extra, *base[100:]]
        words.insert(i % 90, f"own{i}")
        rows.append((i, " ".join(words)))
    got, counts = met(spark, monkeypatch, rows)
    assert got == brute(rows, 4, 85)
    assert counts["star"] + counts["met"] + counts.get("open", 0) <= 16 * n, counts


@pytest.mark.parametrize("seed", range(2))
def test_shared_edits_of_every_size_equal_brute_force(spark, monkeypatch, seed):
    rng, rows = random.Random(seed), []
    for f in range(6):
        base = [f"b{f}_{i}" for i in range(rng.randrange(40, 160))]
        inserts = [[f"s{f}_{x}_{j}" for j in range(rng.randrange(2, 40))] for x in range(3)]
        for _ in range(40):
            words = list(base)
            for extra in inserts:
                if rng.random() < 0.5:
                    at = rng.choice([0, len(base) // 2, len(words)])
                    words[at:at] = extra[: rng.choice([len(extra), len(extra) // 2])]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"o{rng.random()}"
            if rng.random() < 0.3:
                del words[: rng.randrange(len(words) // 3)]
            rows.append((len(rows), " ".join(words)))
    got, _ = met(spark, monkeypatch, rows)
    assert got == brute(rows, 4, 85)
