"""Each operator against brute force or its library, with odd rows of every kind."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, exact_dedup, licenses, ngram_join, pieces, quality, substrings, token_counts, toxicity, urls
from tracewright.llm.graph import components

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Null and empty texts, blanks, ties, repeated rows, null ids; extra columns whose names clash.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a"), (5, "É ß 😀 \x00 x"), (6, "word " * 5000), (7, "▁ <s> <|endoftext|>  y")]
SCHEMA = "doc_id long, text string, ord long, n long, digest string, score double, labels string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, "d", 0.5, "l") for i, t in rows], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


RUNS = {
    "licenses": licenses.scan_licenses,
    "dedup": exact_dedup.deduplicate,
    "tokens": lambda df: token_counts.count_tokens(df, BPE),
    "pieces": lambda df: pieces.encode_decode(df, PIECES),
    "join": ngram_join.jaccard_components,
    "substrings": substrings.remove_repeats,
    "quality": lambda df: quality.score_quality(df, df.sparkSession.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")),
    "toxicity": lambda df: toxicity.score_toxicity(df, df.sparkSession.createDataFrame([], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(spark, name):
    got = RUNS[name](frame(spark, ODD))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, _ in ODD)
    assert RUNS[name](frame(spark, []).where("false")).count() == 0


# 1


def test_license_places_match_brute_force():
    found, rng = licenses.automaton(), random.Random(1)
    parts = ["Under", "the MIT-License", "apache", "License, Version 2.0", "cc BY-nc", "under the mit license", "x", "É", "license"]
    for _ in range(300):
        text = rng.choice([" ", "\n", "--"]).join(rng.choices(parts, k=rng.randrange(12)))
        w = words(lower(text), "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        want = sorted((i, k) for p, k in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        got = licenses.scan(text, found)
        assert got["n_words"] == len(w) and [(m["start"], m["label"]) for m in got["matches"]] == want
        assert all(m["end"] - m["start"] == len(next(p for p, k in licenses.BASE.items() if k == m["label"]).split()) for m in got["matches"])


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("MIT", (["mit"], True)),
        ("MIT OR GPL-3.0-only", (["gpl-3", "mit"], True)),
        ("MIT AND GPL-3.0-or-later", (["gpl-3", "mit"], False)),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR (MIT AND Apache-2.0)", (["apache-2", "gpl-2", "mit"], True)),
        ("GPL-2.0 AND MIT OR BSD-3-Clause", (["bsd-3", "gpl-2", "mit"], True)),
        ("(MIT", None), ("MIT OR", None), ("AND MIT", None), ("", None), ("MIT MIT", None), ("MIT */", (["mit"], True)),
    ],
)
def test_license_expressions(expression, want):
    rpn = licenses.postfix(expression)
    assert (licenses.evaluate(rpn) if rpn else None) == want


def test_license_tags_add_labels():
    got = licenses.scan("Released under the MIT license.\n# SPDX-License-Identifier: ISC OR Zlib\n", licenses.automaton())
    assert got["base_labels"] == ["mit"] and got["labels"] == ["isc", "mit", "zlib"] and got["permissive"] and 0 < got["score"] < 1


# 2


def test_dedup_brute_force_and_split(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.choice(["hot  text", "hot text", "hot\ntext", f"t{rng.randrange(9)}", None, ""])) for _ in range(400)]
    got = exact_dedup.deduplicate(frame(spark, rows).repartition(5), counters=2).collect()
    group = {}
    for i, t in rows:
        group.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).digest(), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = group[bytes(r["digest"])]
        assert r["keep_id"] == min(ids) and r["group_size"] == len(ids)
    assert sum(r["kept"] for r in got) == len(group)
    kept = exact_dedup.drop_duplicates(frame(spark, rows)).collect()
    assert len(kept) == len(group) and kept[0]["labels"] == "l"


def test_misra_gries_keeps_the_frequent():
    from collections import Counter

    counts = Counter()
    for k in range(100):
        counts = exact_dedup.misra_gries(counts, Counter({"hot": 5, **{f"{k}-{j}": 1 for j in range(8)}}), 8)
        assert len(counts) <= 8
    assert counts["hot"] > 0


# 3 and 7


def labelled(spark, make, n=240):
    rng = random.Random(3)
    vocabulary = ["the", "tion", "and", "ing", "er", "of", "house", "river", "stone", "green"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(20, 90)))
        y = int(rng.random() < 0.4)
        rows.append((i, make(text, y, rng)))
        labels.append((i, y))
    return frame(spark, rows), labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda t, y, r: t if y else "!! ".join(t.upper().split()))
    got = quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum((r["score"] >= 0.5) == bool(dict(labels)[r["doc_id"]]) for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_sees_the_end_of_long_texts():
    net = quality.fit([b"good text here " * 20, b"BAD!! BAD!! " * 20] * 30, [1, 0] * 30, 0.5)
    tables = net.tables()
    clean = net.logit(b"good text here " * 3000, tables)
    assert net.logit(b"good text here " * 3000 + b"BAD!! BAD!! " * 40, tables) < clean and net.logit(b"", tables) == net.logit(b"", tables)


def test_viterbi_restores_disguised_words():
    corpus = b"the quick idiot and the stupid moron went home " * 50
    lm = toxicity.LanguageModel(toxicity.trigrams(corpus))
    assert [lm.decode(x) for x in ("1d10t", "stuuupid", "m0r0n", "$tup1d", "st*pid")] == ["idiot", "stupid", "moron", "stupid", "stupid"]
    restore = toxicity.Restorer(lm)
    assert "stupid" in restore("so s t u p i d!") and "idiot" in restore("1d10t!!") and restore("plain words") == set()


def test_whole_runs_are_restored():
    lm = toxicity.LanguageModel(toxicity.trigrams(b"the quick idiot and a stupid moron went home " * 50))
    restore = toxicity.Restorer(lm)
    text = "the quick moron went home and the quick moron went home and the quick idiot and a stupid moron"
    assert restore(" ".join(text.replace(" ", ""))) == set(text.split())
    assert restore("a s t u p i d") == {"a", "stupid"} and restore("so s t u p i d!") == {"stupid"}
    assert restore("id" + 45 * "i" + "ot") == {"idiot"} and restore("m0r0n" * 9) == {"moron" * 9}
    assert len(lm.decode("a1" * 20_000, True).replace(" ", "")) == 40_000


def test_toxicity_on_held_out_rows(spark):
    def make(text, y, rng):
        return text + (" " + rng.choice(["idiot", "1diot", "i d i o t", "idiooot"]) if y else "")

    docs, labels = labelled(spark, make, 400)
    docs = docs.unionByName(frame(spark, [(10_000, "idiot " * 40)]))
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 10_000]
    assert sum((r["score"] >= 0.7) == bool(dict(labels)[r["doc_id"]]) for r in held) / len(held) > 0.95


# 4 and 5

TEXTS = [t for _, t in ODD if t] + ["it's we'll 'tis", "a  b\t\nc \n d", " lead", "trail ", "x" * 900, "foo.Bar,baz!!", "日本語 текст", "a\u00a0b\u3000c \u2028 d", "<|endoftext|><|endoftext|>", "123 45.6e7", "don't\n\n \nstop", "▁▁ a ▁"]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library, count = Tokenizer.from_file(BPE), token_counts.counter(BPE)
    rng = random.Random(4)
    more = ["".join(rng.choices("ab é'\n\t ,1😀ß", k=rng.randrange(30))) for _ in range(2000)]
    for t in TEXTS + more:
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    whole = token_counts.prove_whole_tokens(library)
    assert " the" in whole and "xqzj" not in whole


def test_pieces_equal_the_library():
    codec = pieces.Codec(PIECES)
    rng = random.Random(5)
    more = ["".join(rng.choices("ab é▁\n\t ,1😀ß", k=rng.randrange(30))) for _ in range(2000)]
    texts = TEXTS + more + [""]
    for t, (ids, text) in zip(texts, codec(texts), strict=True):
        want = codec.model.encode(t, add_bos=True, add_eos=True)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want) and text == codec.model.decode(want), t
    assert pieces.crossing_pieces(codec.model) == []


# 6


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed, n=150):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))] for _ in range(8)]
    line = [f"shared{j}" for j in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [f"u{rng.randrange(999)}" for _ in range(30)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        if rng.random() < 0.4:
            w += line
        rows.append((i, " ".join(w)))
    return rows + [(n, ""), (n + 1, None), (n + 2, "a b"), (n + 3, "A  B"), (n + 4, rows[0][1])]


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_join_finds_all_links(spark, k, percent, seed):
    rows = near_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_near_dedup_keeps_the_smallest(spark):
    rows = near_rows(3)
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in ngram_join.keep_one_of_each(frame(spark, rows)).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(1, 5), (5, 9), (3, 9), (50, 50), (7, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(20, 41), 20) | dict.fromkeys((1, 3, 5, 9), 1) | {7: 7, 60: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choices("abcdeé日", k=rng.randrange(2, 8))) for _ in range(n))
    items = [(j, make(rng.randrange(8, 30))) for j in range(6)] + [(6, None), (7, "short")]
    docs = []
    for i in range(60):
        p = list(items[rng.randrange(6)][1])
        for _ in range(rng.randrange(int(len(p) * 0.16) + 1)):
            k = rng.randrange(len(p))
            p[k : k + rng.randrange(2)] = rng.choice(["", "z", "qq"])
        docs.append((i, f"{make(rng.randrange(9))}\n{''.join(p)}  {make(rng.randrange(9))}".title()))
    docs += [(i and i + 1000, t) for i, t in ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    for i, t in docs[:60]:
        for j, p in items[:6]:
            q, least = decontaminate.normalise(p), None
            least = edits(q, decontaminate.normalise(t))
            assert got.get((i, j)) == (least if least <= int(len(q) * 0.1) else None)
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, docs), bench).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.contaminated(frame(spark, docs), bench.where("false")).count() == 0


def test_short_passages_have_the_whole_budget(spark):
    rng = random.Random(9)
    items = [(n, "".join(rng.choices("abcdefghijklmnop", k=n))) for n in (*range(8, 45), 50)]
    docs = []
    for n, p in items:
        for k in range(n // 10 + 2):
            q = list(p)
            for at in range(k):  # the edits stand evenly, so long q-grams are lost
                q[(at + 1) * n // (k + 1)] = "z"
            docs.append((100 * n + k, f"wwww {''.join(q)} yyyy"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    want = {(i, n): e for i, t in docs for n, p in items if (e := edits(p, t)) <= int(n * 0.1)}
    assert got == want and (1001, 10) in want and (2002, 20) in want and (3003, 30) in want


def test_places_equal_brute_force():
    """Begin and end: of the regions with the fewest edits the first to end, then the shortest."""
    rng = random.Random(10)
    p = "".join(rng.choices("abcd", k=40))
    for _ in range(30):
        q = list(p)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(q))
            q[k : k + rng.randrange(2)] = rng.choice(["", "a", "zz"])
        t = "xyx " + "".join(q) + " yyx " + p[:20]
        found = decontaminate.search([t], decontaminate.Index.of([(1, p)], 0.1, 5))
        every = [(whole(p, t[a:z]), z, -a) for z in range(len(t) + 1) for a in range(max(0, z - 46), z + 1)]
        least, end, begin = min(every)
        assert found == ([(0, 0, -begin, end, least)] if least <= 4 else [])


def whole(p, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_common_beginnings_are_aligned_once(monkeypatch):
    """2,000 passages with one beginning that a document repeats: equal to a plain search, in bounded pieces."""
    rng = random.Random(11)
    make = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    stem = "q" + make(48) + "q"
    items = [(j, stem + make(50)) for j in range(2000)]
    docs = [" ".join(stem for _ in range(50)), " ".join(stem for _ in range(20)) + items[7][1] + "x" + items[9][1][:60] + "zz" + items[9][1][60:], "nothing"]
    indexes = decontaminate.Index.all_of(items)
    classes = sum(len(np.unique(x.of_class)) for x in indexes)
    assert classes < 2 * len(items) + 100
    began = time.perf_counter()
    name = lambda found, x: {(d, x.ids[i], c) for d, i, _, _, c in found}
    got = set().union(*(name(decontaminate.search(docs, x), x) for x in indexes))
    assert time.perf_counter() - began < 20  # 32 s for the first document alone when each passage was aligned by itself
    small = [items[k] for k in (7, 9, 11, 500)]
    want = {(d, j, e) for d in (1, 2) for j, p in small if (e := edits(decontaminate.normalise(p), decontaminate.normalise(docs[d]))) <= int(len(decontaminate.normalise(p)) * 0.1)}
    assert {g for g in got if g[1] in (7, 9, 11, 500)} == want and {(1, 7), (1, 9)} <= {g[:2] for g in want}
    monkeypatch.setattr(decontaminate, "ROWS", 1000)
    monkeypatch.setattr(decontaminate, "CELLS", 20_000)
    few = decontaminate.Index.all_of(items[:40])
    assert set().union(*(name(decontaminate.search(docs, x), x) for x in few)) == {g for g in got if g[1] < 40}


# 9


def test_urls(spark):
    rows = [
        (1, "http://A.Example.org/es/x?y", ("a.example.org", "/es/x", "example.org/es/", "block")),
        (2, "https://example.org/en/12#t", ("example.org", "/en/12", "example.org/en/1", "block")),
        (3, "https://x.org/", ("x.org", "/", "org/", "allow")),
        (4, "https://x.org", ("x.org", "", None, "allow")),
        (5, "http://b.com/de/1", ("b.com", "/de/1", "com/de/", "block")),
        (6, "no scheme", ("", "", None, "allow")),
        (7, None, ("", "", None, "allow")),
        (8, "https://www.casinobonus.net/play", ("www.casinobonus.net", "/play", None, "block")),
        (8, "http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        (None, "ftp://h?a/b://c", ("h", "", None, "allow")),
        *((k, f"https://blog.riverstone.net/{k}", ("blog.riverstone.net", f"/{k}", None, "allow")) for k in range(20, 40)),
    ]
    got = urls.judge(spark.createDataFrame([(i, u, "h") for i, u, _ in rows], "page_id long, url string, host string")).collect()
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {(i, *w) for i, _, w in rows}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_segmentation():
    split = urls.Segmenter({"cheap": 5, "pills": 5, "river": 50, "stone": 40})
    assert split("cheappills") == ["cheap", "pills"] and split("riverstone") == ["river", "stone"] and split("") == []


def test_every_word_counts_on_large_page_tables(spark):
    import math

    n, long = 210_000, "counterrevolutionariesandothers"
    many = spark.range(n).select(F.concat(F.lit("https://q"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(".net/")).alias("url"))
    few = [f"https://casino-zebra.net/zzz/{long}", "https://quiet.net/zzz", f"https://river{long}.net/river"]
    pages = many.unionByName(spark.createDataFrame([(u,) for u in few], "url string")).select(F.lit(1).alias("page_id"), "url")
    rows = urls.judge(pages).cache()
    got = {r["path"]: r for r in rows.where("path <> '/'").collect()}
    assert rows.count() == n + 3 and got["/river"]["words"] == ["river", long, "/river"]
    assert got[f"/zzz/{long}"]["words"] == ["casino", "zebra", "/zzz", f"/{long}"]
    # Distinct words of both classes, and how often each was seen.
    seen = rows.select(F.explode("words").alias("w")).agg(F.count("w"), F.count_distinct("w")).first()
    base = math.log((seen[0] - 4 + seen[1] + 1) / (4 + seen[1] + 1))
    want = math.log(2 / (n + 3)) + 2 * base + math.log(1 / 2) + math.log(2 / 2)
    assert got["/zzz"]["words"] == ["quiet", "/zzz"] and got["/zzz"]["score"] == pytest.approx(want)


def test_segments_are_the_most_probable_of_all():
    import itertools
    import math

    rng = random.Random(12)
    for _ in range(40):
        counts = {"".join(rng.choices("ab", k=rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(6)}
        name, split = "".join(rng.choices("abc", k=8)), urls.Segmenter(counts, 200)
        value = lambda ws: sum(math.log(counts[w] / 200) if w in counts else -math.log(200) - len(w) * math.log(10) for w in ws)  # noqa: B023, E731
        cuts = ([0, *c, 8] for r in range(8) for c in itertools.combinations(range(1, 8), r))
        assert value(split(name)) == pytest.approx(max(value([name[a:z] for a, z in itertools.pairwise(c)]) for c in cuts))


def test_verdicts_equal_a_plain_bayes(spark):
    import collections
    import math

    rng = random.Random(13)
    some = [*"casino river stone poker".split(), "zebra", "quiet", "loans", "map"]
    every = [f"http://{rng.choice(['', 'www.'])}{''.join(rng.choices(some, k=rng.randrange(1, 3)))}{rng.choice(['', '-' + rng.choice(some)])}.{rng.choice(['net', 'org', 'com'])}/{rng.choice(['', 'de/', 'fr/'])}{rng.choice(some)}/{''.join(rng.choices(some, k=2))}" for _ in range(150)]
    long = "".join(rng.choices(some, k=40_000))  # a name of some 200,000 letters
    every += [None, "", "river", "http:///x", f"http://q.net/{long}"] + every[:5]
    got = urls.judge(spark.createDataFrame(list(enumerate(every)), "page_id long, url string")).collect()
    assert len(got) == len(every)

    def cut(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return host.lower(), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    runs = lambda x: re.findall("[a-z]+", x)
    bare = lambda h: h.rsplit(".", 1)[0] if "." in h else h
    counts = collections.Counter({w: urls.SEED for w in urls.UNWANTED | urls.COMMON})
    for h, p in map(cut, every):
        counts.update(runs(" ".join([x for x in bare(h).split(".") if re.search("[^a-z]", x)] + [p.lower()])))
    split = urls.Segmenter(dict(counts))
    told = [[w for n in runs(bare(h) or h) for w in split(n)] + ["/" + w for n in runs(p.lower()) for w in split(n)] for h, p in map(cut, every)]
    bad = [not urls.UNWANTED.isdisjoint(ws) for ws in told]
    seen = [collections.Counter(w for ws, b in zip(told, bad, strict=True) if b == k for w in ws) for k in (False, True)]
    size = len(seen[0] | seen[1]) + 1
    base = math.log((seen[0].total() + size) / (seen[1].total() + size))
    for r in got:
        ws = told[r["page_id"]]
        score = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1)) + sum(base + math.log((seen[1][w] + 1) / (seen[0][w] + 1)) for w in ws)
        assert (r["host"], r["path"], r["words"]) == (*cut(every[r["page_id"]]), ws) and r["score"] == pytest.approx(score)
        assert r["rule"] or r["verdict"] == ("block" if r["score"] > 0 else "allow")


# 10


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(10)
    passages = [[f"p{rng.randrange(300)}" for _ in range(rng.choice([49, 50, 51, 75, 120]))] for _ in range(6)]
    passages.append(["same"] * 70)
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(4)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, None), (203, " ")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(frame(spark, rows).repartition(6)).collect()}
    assert got == brute_repeats(rows)


def test_rows_that_share_an_id_keep_their_words(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    got = substrings.remove_repeats(frame(spark, [(5, a), (5, b), (5, a), (6, b), (None, a)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("5", 0), ("5", 0), ("6", 60), ("None", 60)]


def test_bitmap_has_no_false_negatives(spark):

    from tracewright.llm.common import Bits

    values = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = Bits.of(values)
    assert bits.has(values.toPandas()["h"].to_numpy().view(np.uint64)).all() and not Bits.of(values.where("false")).words.any()
