"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries name the few digests that may be frequent; their exact
winners are broadcast and resolve their rows map-side, so no hot group is ever
shuffled.  All other digests take an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, unused, without

#: Counters of a Misra-Gries summary: digests above 1/COUNTERS of a partition's
#: rows are always in it.  It bounds the broadcast too.
COUNTERS = 1024


def normalised(text):
    """Runs of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def misra_gries(counts: Counter, items: Counter, k: int) -> Counter:
    """Add ``items`` to a summary of at most k counters (the mergeable form)."""
    counts.update(items)
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = Counter({x: n - cut for x, n in counts.items() if n > cut})
    return counts


def heavy_candidates(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k digests, among them each with more than a share of about 2/k of the rows.

    Each partition sends at most k counters of what is left above its cut; their
    sums (a partial aggregation) are lower bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            got = b.column(0).value_counts()
            counts = misra_gries(counts, Counter(dict(zip(got.field(0).to_pylist(), got.field(1).to_pylist(), strict=True))), k)
        counts = Counter({x: n for x, n in counts.items() if n > 1})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    summed = digests.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "digest").limit(k).select("digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (SHA-256).

    Of rows whose normalised texts are equal the one with the smallest id stays;
    null ids come last.  Rows repeating both text and id are copies too: exactly
    one of them is kept.  Null and empty texts are equal to each other (a text of
    blanks only is another: one blank).  An empty table gives no rows.

    The digests are computed once and written as a narrow table (40 bytes a row);
    texts are never shuffled.  Broadcast: at most ``counters`` rows.
    """
    table = durable(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col).cast("string")), 256)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    win = [F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")]
    candidates = F.broadcast(heavy_candidates(table, counters))
    winners = durable(table.join(candidates, "digest", "left_semi").groupBy("digest").agg(*win).where("group_size > 1"), "winners")
    decided = lambda df: df.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )
    heavy = table.join(F.broadcast(winners), "digest")
    light = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    ordinary = light.join(light.groupBy("digest").agg(*win), "digest")
    return decided(heavy).unionByName(decided(ordinary))


def drop_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`deduplicate` keeps.

    No text is shuffled but those of ids that go, and of rows that repeat both id and
    text, which a distinct over just those rows thins to one.
    """
    name = unused(docs, "digest")
    decisions = durable(deduplicate(docs, counters=counters), "decisions")
    ids = decisions.groupBy("doc_id", F.col("digest").alias(name)).agg(F.count_if("kept").alias("n_kept"), F.count(F.lit(1)).alias("n_all"))
    odd = durable(ids.where("n_kept = 0 or n_all > 1"), "losers")
    release(decisions)
    keyed = docs.withColumn(name, F.unhex(F.sha2(normalised(F.col("text").cast("string")), 256)))
    key = ["doc_id", name]
    rest = without(keyed, odd, key)
    twice = odd.where("n_kept > 0").select(F.struct(*key).alias("twice"))
    if not twice.isEmpty():
        same = [keyed[c].eqNullSafe(twice["twice"][c]) for c in key]
        rest = rest.unionByName(keyed.join(twice, same, "left_semi").dropDuplicates(key))
    return rest.drop(name)
