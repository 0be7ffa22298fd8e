"""Merkle manifest, language field and filter audit against brute force, with odd rows."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import audit, language, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos long, tampered string, n long, mask int, part string"
ODD = [
    (1, None, "en", 3, None),
    (2, None, None, None, ""),
    (3, "b", "en", 3, " \t\n"),
    (4, "b", "fr", 1, "A"),
    (4, "b", "fr", 1, "A"),
    (None, "b", "fr", 1, "A"),
    (None, None, None, None, None),
    (5, "", "de", 9, "É ß 😀 \x00 X 12"),
    (6, "ä", "en", 9, "Word " * 30000),
    (7, "z", "en", 3, "123 — 456"),
    (15, "z", "en", 3, "ALL CAPS"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "t", 2, 3, "p") for r in rows], SCHEMA)


# 11


def h(*children):
    return sha256("".join(children).encode()).hexdigest()


def slow_manifest(rows, fan=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    leaves = {s: sorted(((r[0], h(*map(field, r)), r) for r in by[s]), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in order}
    trees = {s: tree([x[1] for x in leaves[s]]) for s in order}
    over = tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for p, (i, leaf, r) in enumerate(leaves[s]):
            bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            at = h(*map(field, (*r[:-1], low(r[-1])))) if bad else leaf
            proof = []
            for levels, k in ((trees[s], p), (over, g)):
                for level in levels[:-1]:
                    run = level[k - k % fan : k - k % fan + fan]
                    left, right = run[: k % fan], run[k % fan + 1 :]
                    proof += left + right
                    at = h(*left, at, *right)
                    k //= fan
            out.append((i, leaf, trees[s][-1][0], over[-1][0], h(*proof), at, at == over[-1][0]))
    return sorted(out, key=str)


def some_rows(n, sources, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), "en", i % 7, rng.choice(["Abc", "x", None, "É"]) and f"T{i % 50}") for i in range(n)]


@pytest.mark.parametrize("top", [merkle.TOP, 3])
def test_manifest_matches_plain_trees(spark, top):
    # groups of one leaf, one block, several blocks and a last block of one row
    rows = some_rows(900, ["a", "b", None, "", "ä"]) + [(10_000 + i, "one", "en", 1, "t") for i in range(1)] + [(20_000 + i, "long", "en", 1, "T") for i in range(257)] + ODD
    got = sorted((tuple(r) for r in merkle.manifest(frame(spark, rows), top=top).collect()), key=str)
    assert got == slow_manifest(rows)


def test_manifest_of_many_groups_is_distributed(spark):
    rows = [(i, f"s{i % 300:04d}", "en", 1, "T") for i in range(700)] + [(5000 + i, "s0007", "en", 1, "T") for i in range(600)] + [(9000 + i, None, "en", 1, "T") for i in range(300)]
    got = sorted((tuple(r) for r in merkle.manifest(frame(spark, rows), top=8).collect()), key=str)
    assert got == slow_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(frame(spark, [(3, "s", None, None, None)])).collect()
    assert [tuple(r) for r in one] == slow_manifest([(3, "s", None, None, None)])
    assert one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] and one[0]["proof_sha256"] == h("")
    assert merkle.manifest(frame(spark, []).where("false")).count() == 0


# 12


def slow_marginals(field, scores, opens):
    out = []
    starts = [*np.flatnonzero(opens), len(scores)]
    for a, b in itertools.pairwise(starts):
        logs = np.full((b - a,) * 0 + (len(field.labels),) * (b - a), 0.0)
        for path in np.ndindex(*logs.shape):
            s = field.begin[path[0]] + sum(scores[a + t, y] for t, y in enumerate(path))
            logs[path] = s + sum(field.moves[x, y] for x, y in itertools.pairwise(path))
        p = np.exp(logs - logs.max())
        p /= p.sum()
        out += [[p.take(y, axis=t).sum() for y in range(len(field.labels))] for t in range(b - a)]
    return np.array(out)


def test_forward_backward_sums_over_all_label_paths():
    rng = np.random.default_rng(0)
    field = language.Field(["a", "b", "c"], np.zeros((1, 3)), rng.normal(0, 2, (3, 3)), rng.normal(0, 1, 3), (np.zeros(0, np.uint64),) * 2)
    opens = np.zeros(300, bool)
    opens[np.cumsum([0] + [int(rng.integers(1, 7)) for _ in range(45)])] = True
    last = np.flatnonzero(opens)[-1] + 4
    scores = rng.normal(0, 3, (300, 3))[:last]
    assert np.allclose(field.marginals(scores, opens[:last]), slow_marginals(field, scores, opens[:last]))


def test_one_long_chain_passes_from_row_to_row():
    rng = np.random.default_rng(1)
    field = language.Field(["a", "b"], np.zeros((1, 2)), np.array([[3.0, 0], [0, 3.0]]), np.zeros(2), (np.zeros(0, np.uint64),) * 2)
    n = 5 * language.CHUNK + 17
    scores, opens = rng.normal(0, 1, (n, 2)), np.zeros(n, bool)
    opens[0] = True
    move, psi = np.exp(field.moves), np.exp(scores)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(n):
        x = psi[t] if t == 0 else (a[t - 1] @ move) * psi[t]
        a[t] = x / x.sum()
    for t in range(n - 2, -1, -1):
        x = move @ (psi[t + 1] * b[t + 1])
        b[t] = x / x.sum()
    want = a * b / (a * b).sum(axis=1, keepdims=True)
    assert np.allclose(field.marginals(scores, opens), want)


def test_words_are_runs_of_letters_of_one_text():
    col = pa.array(["ab, É9c", "", "d", "1", "e"])
    at, data = audit.buffers(col)
    start, end, row = language.word_spans(data, at)
    assert [(data[s:e].tobytes().decode(), r) for s, e, r in zip(start, end, row, strict=True)] == [("ab", 0), ("É", 0), ("c", 0), ("d", 2), ("e", 4)]


VOCABULARY = {"xx": "zor zimp zanka uzo zelt", "yy": "mibba bim obbu imba bom", "ww": "keft trik rekt tirk ekrit"}


def made(lang, rng, n=40):
    return " ".join(rng.choice(VOCABULARY[lang].split()) + rng.choice(["", rng.choice(VOCABULARY[lang].split())]) for _ in range(n))


def test_language_of_held_out_and_mixed_texts(spark):
    rng = random.Random(2)
    rows = [(i, "s", lang, 1, made(lang, rng)) for i in range(240) for lang in [sorted(VOCABULARY)[i % 3]]]
    got = {r["doc_id"]: r for r in language.predict(frame(spark, rows)).collect()}
    for i, _, lang, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
    switched = made("xx", rng, 20) + ". " + made("yy", rng, 20) + "! " + made("ww", rng, 20)
    spans = language.labelled(frame(spark, [*rows, (999, "s", None, 1, switched)])).where("doc_id = 999").first()["spans"]
    assert [s["lang"] for s in spans] == ["xx", "yy", "ww"]
    assert switched.encode()[spans[1]["first"] : spans[1]["end"]].decode() == switched.split(". ")[1].split("!")[0]


def test_language_learns_from_no_held_out_row(spark):
    rng = random.Random(3)
    rows = [(i, "s", "xx" if i % 2 else "yy", 1, made("xx" if i % 2 else "yy", rng)) for i in range(80)]
    changed = [(i, s, "ww" if zlib.crc32(str(i).encode()) % 4 == 2 else x, n, t) for i, s, x, n, t in rows]
    a, b = (sorted(map(tuple, language.predict(frame(spark, r)).collect())) for r in (rows, changed))
    assert a == b and {r[2] for r in a} == {"xx", "yy"}


def test_language_of_odd_rows(spark):
    got = sorted(language.predict(frame(spark, ODD)).collect(), key=str)
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert all(by[i]["lang_pred"] in {"en", "fr", "de"} for i in (4, 5, 6, 15))
    assert by[6]["n_words"] == 30000
    blank = language.predict(frame(spark, [(1, "s", None, 1, "abc")])).first()
    assert (blank["lang_pred"], blank["score"]) == ("und", 0)
    one = language.predict(frame(spark, [(2, "s", "en", 1, "abc")])).first()
    assert (one["lang_pred"], one["score"]) == ("en", 1)
    assert language.predict(frame(spark, []).where("false")).count() == 0


# 13


def slow_mask(text, repeats):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), repeats]
    return [bool(f) for f in fails]


def slow_audit(rows, labels):
    quality, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, *_, t in rows:
        key = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", key), key)
    docs = [(lang or "", slow_mask(t or "", least[t or ""] < (i is None, i or 0)), i in quality, i in toxic) for i, _, lang, _, t in rows]
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            gone = [False] * len(mine)
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                here = [d[1][k] and not g for d, g in zip(mine, gone, strict=True)]
                redundant = sum(d[1][k] and g for d, g in zip(mine, gone, strict=True))
                gone = [g or x for g, x in zip(gone, here, strict=True)]
                shapley[letter] += sum(here)
                good, bad = (sum(x and d[n] for d, x in zip(mine, here, strict=True)) for n in (2, 3))
                out[part, "".join(order), step] = [gone.count(False), sum(here), redundant, sum(d[1][k] and sum(d[1]) == 1 for d in mine), good, bad, letter]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def test_audit_matches_every_order_done_plainly(spark):
    rng = random.Random(4)
    kinds = ["a b c " * 40, " ".join(f"w{i}" for i in range(120)), "SHOUT " * 101, "x $ y", "", None, "É" * 9 + "A", " ".join(f"W{i}" for i in range(150)), "a\x0bb\x1cc d"]
    rows = [(rng.choice([i, i, i - 1]), "s", rng.choice(["en", "fr", None, ""]), 1, rng.choice(kinds)) for i in range(150)] + ODD
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(120)] + [(3, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: list(r)[3:] for r in audit.audit(frame(spark, rows), table).collect()}
    assert got == slow_audit(rows, labels)
    assert audit.audit(frame(spark, []).where("false"), table).count() == 0
    assert audit.audit(frame(spark, ODD), table.where("false")).count() == 600 * len({x or "" for _, _, x, *_ in ODD})


def test_masks_with_colliding_word_hashes():
    texts = [" ".join(f"w{i % 90}" for i in range(110)), "", "b a b", "a", "ABC def", "x" * 5000 + " " + "x" * 5000, " ".join(f"v{i}" for i in range(101))]
    want = [sum(f << k for k, f in enumerate(slow_mask(t, False))) for t in texts]
    for word_hash in (audit.hashing.hashed, lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: (e - s).astype(np.uint64)):
        assert audit.masks(pa.array(texts), word_hash).tolist() == want
        assert audit.masks(pa.array(["skip", *texts]).slice(1), word_hash).tolist() == want
