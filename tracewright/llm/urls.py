"""URL filters: rules first, then a naive Bayes verdict on segmented host names.

Concatenated names are split into words by a unigram Viterbi; a multinomial
naive Bayes scores the words of host and path.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bits, durable, tidy

#: Verdict, rule: a host (with its subdomains) and the beginning of a path (fixed values).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Words that mark a host as unwanted where nothing else is known (fixed values).
UNWANTED = frozenset("adult ads advert bet bets betting bonus casino cheap click escort free gambling jackpot loan loans lottery malware payday pharma phish pills poker porn prize promo replica sex slots spam tracker track viagra warez win xxx".split())
#: Common parts of names, known before any count (fixed values).
COMMON = frozenset("api app blog book cloud data dev doc docs example farm forum game home host info learn library mail map media music net news online open page photo school science shop site store team tech test the tools travel video weather web wiki work world www".split())
#: Pseudo-count of the words above.
SEED = 5
#: Parts of names that a worker looks up at once.
CHUNK = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, begin = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{begin}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parts(names: Column) -> Column:
    """Runs of letters of lower-cased names."""
    return F.regexp_extract_all(names, F.lit("([a-zß-öø-ÿ]+)"), F.lit(1))


@dataclass
class Segmenter:
    """Most probable split of a name under word frequencies; an unknown word of n
    letters has probability 1/(total * 10**n).

    ``counts`` need hold no other words than those that occur in the name; ``total``
    is that of all words (and 1).
    """

    counts: dict[str, int]
    total: int = 0

    def __post_init__(self) -> None:
        self.total = self.total or sum(self.counts.values()) + 1

    def __call__(self, name: str) -> list[str]:
        all_words, letter = math.log(self.total), math.log(10)
        lengths = sorted({len(w) for w in self.counts})
        best, begin = array("d", [0.0]), array("q", [0])
        unknown = (0.0, 0)  # where an unknown word had best begin, whatever its length
        for end in range(1, len(name) + 1):
            most = (unknown[0] - end * letter - all_words, unknown[1])
            for k in lengths:
                if k <= end and (n := self.counts.get(name[end - k : end])):
                    most = max(most, (best[end - k] + math.log(n) - all_words, end - k))
            best.append(most[0])
            begin.append(most[1])
            unknown = max(unknown, (most[0] + end * letter, end))
        words, end = [], len(name)
        while end:
            words.append(name[begin[end] : end])
            end = begin[end]
        return words[::-1]


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, pieces) of distinct ``names`` under the table ``words`` (word, n).

    The words stay distributed: a bitmap tells which parts of a name may be words,
    and only those are joined with their counts.  Parts are made and tested a chunk at
    a time and travel with a hash of their name (128 bits), so a very long name costs
    its own length and the words in it, not all its parts.
    """
    sc = names.sparkSession.sparkContext
    total = words.agg(F.sum("n")).first()[0] + 1
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    bits = sc.broadcast(Bits.of(words.select(F.crc32(F.col("word").cast("binary")))))

    def passing(parts: list[str]) -> Iterator[str]:
        has = bits.value.has(np.fromiter((zlib.crc32(w.encode()) for w in parts), np.uint64, len(parts)))
        return (parts[k] for k in np.flatnonzero(has).tolist())

    @tidy
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            asked: list[tuple[bytes, set, list]] = []  # names whose parts wait for the bitmap together
            size = 0

            def settle() -> None:
                flat = [w for _, _, parts in asked for w in parts]
                has = iter(bits.value.has(np.fromiter((zlib.crc32(w.encode()) for w in flat), np.uint64, len(flat))).tolist())
                for key, known, parts in asked:
                    known.update([w for w in parts if next(has)])
                    keys.extend([key] * len(known))
                    found.extend(known)
                asked.clear()

            for key, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(name) * len(lengths) > CHUNK:  # by itself, a chunk of its parts at a time
                    known: set[str] = set()
                    for k in lengths:
                        for at in range(0, len(name) - k + 1, CHUNK):
                            known.update(passing([name[s : s + k] for s in range(at, min(at + CHUNK, len(name) - k + 1))]))
                    keys.extend([key] * len(known))
                    found.extend(known)
                else:
                    asked.append((key, set(), list({name[s : s + k] for k in lengths if k <= len(name) for s in range(len(name) - k + 1)})))
                    size += len(asked[-1][2])
                if size >= CHUNK or len(found) >= CHUNK:
                    settle()
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "word"])
                    keys, found, size = [], [], 0
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "word"])

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            pieces = [Segmenter({r["word"]: r["n"] for r in known or []}, total)(name) for name, known in zip(names, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.list_(pa.string()))], names=["name", "pieces"])

    keyed = names.select(F.unhex(F.md5(F.col("name").cast("binary"))).alias("key"), "name")
    known = keyed.mapInArrow(candidates, "key binary, word string").join(words, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return keyed.join(known, "key", "left").select("name", "known").mapInArrow(split, "name string, pieces array<string>")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, words, score.

    A rule that fits decides; else naive Bayes does, block at log-odds above 0.
    Urls without ``://`` and null urls have empty host and path and no words, so the
    class shares decide (allow unless most urls are unwanted).  Ids may be null or
    repeat; an empty table gives no rows.

    Word frequencies (of paths, and of host names that signs divide) and class counts
    come from all urls and keep every word, of any length.  They stay distributed
    and are joined to distinct names and words; the driver sees sums only.  Classes
    start from hosts that name an unwanted thing.
    """
    spark = pages.sparkSession
    url, key = F.col(url_col).cast("string"), ["host", "path"]
    df = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = durable(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "urls")
    # A name in one piece says nothing about its words; parts set apart by a sign do.
    bare = F.regexp_replace("host", r"\.[^.]*$", "")
    divided = F.filter(F.split(bare, r"\."), lambda x: x.rlike("[^a-zß-öø-ÿ]"))
    seeds = spark.createDataFrame([(w, SEED) for w in sorted(UNWANTED | COMMON)], "word string, n long")
    named = urls.select(F.explode(parts(F.lower(F.concat_ws(" ", divided, "path")))).alias("word"), "n")
    words = durable(named.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "words")

    # Words of the host without its last label, then of the path.
    marked = lambda names, mark: F.transform(names, lambda x: F.struct(F.lit(mark).alias("mark"), x.alias("name")))
    items = F.concat(marked(parts(F.when(bare != "", bare).otherwise(F.col("host"))), ""), marked(parts(F.lower("path")), "/"))
    places = urls.select(*key, F.posexplode(items).alias("at", "item")).select(*key, "at", "item.mark", "item.name")
    splits = durable(split_names(places.select("name").distinct(), words), "splits")
    pieces = F.transform("pieces", lambda w: F.concat("mark", w))
    joined = places.join(splits, "name").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", pieces.alias("words")))).alias("told"))
    told = urls.join(joined, key, "left").select(*key, "n", F.coalesce(F.flatten("told.words"), F.array().cast("array<string>")).alias("words"))
    told = durable(told.withColumn("bad", F.arrays_overlap("words", F.array(*map(F.lit, sorted(UNWANTED))))), "told")

    block, allow = F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n")))
    counts = durable(told.select(F.explode("words").alias("word"), "n", "bad").groupBy("word").agg(block.alias("block"), allow.alias("allow")), "classes")
    rows = [n or 0 for n in told.agg(block, allow).first()]
    seen = [n or 0 for n in counts.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1)) + 1).first()]
    prior, base = math.log((rows[0] + 1) / (rows[1] + 1)), math.log((seen[1] + seen[2]) / (seen[0] + seen[2]))

    # Log-odds of block against allow.
    weight = F.lit(base) + F.log((F.col("block") + 1) / (F.col("allow") + 1))
    weighed = told.select(*key, F.posexplode("words").alias("at", "word")).join(counts, "word").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", weight.alias("w")))).alias("odds"))
    score = F.aggregate(F.coalesce("odds.w", F.array().cast("array<double>")), F.lit(prior), lambda a, w: a + w)
    scored = told.join(weighed, key, "left").select(*key, "words", score.alias("score"))
    out = df.join(scored, key, "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")
