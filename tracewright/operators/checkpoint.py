"""Processed tasks: an append-only table of ids instead of a rewritten file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(tasks: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Tasks still to run; all of them if forced."""
    return tasks if force else tasks.join(done.select(key).distinct(), key, "left_anti")


#: Bits for each finished id, and bits of a bitmap at most (32 MB sent to every executor).
BITS_EACH, MOST_BITS = 16, 1 << 28


def pending_by_bitmap(tasks: DataFrame, done: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """As :func:`pending`, but only tasks whose hash is that of a finished id are shuffled.

    Hashes of finished ids fill a bitmap of ``bits``, by default 16 for each id, in
    pieces of 4 KB: as partial aggregation, so a task sends as many pieces as there are, not
    ids.  A task whose bit is 0 is surely pending (about 15 of 16 unfinished ones); the others
    meet the ids in an anti-join.  A bitmap that would be over half full at its largest
    size tells too little, and the plain anti-join takes over; results are the same.
    Null keys are pending.
    """
    done = done.select(F.col(key).cast("string").alias(key))
    if bits is None:
        n = done.count()
        if n > MOST_BITS // 2:
            return pending(tasks, done, key)
        bits = min(MOST_BITS, max(1 << 15, n * BITS_EACH))
    surely, maybe = _parted(tasks, done, key, bits)
    names = done.distinct().withColumnRenamed(key, "__done")
    return surely.unionByName(maybe.join(names, F.col(key).cast("string") == F.col("__done"), "left_anti"))


def _parted(tasks: DataFrame, done: DataFrame, key: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Tasks that are surely pending, and those that may be done."""
    tasks_key = F.col(key).cast("string")
    at = lambda c: F.pmod(F.xxhash64(c), bits) + 1
    ids = F.col(key)
    pieces = done.where(ids.isNotNull()).select(F.bitmap_bucket_number(at(ids)).alias("__piece"), F.bitmap_bit_position(at(ids)).alias("__bit"))
    pieces = pieces.groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
    bit = F.bitmap_bit_position(at(tasks_key))
    byte = F.conv(F.hex(F.substring("__bitmap", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    probed = tasks.withColumn("__piece", F.when(tasks_key.isNotNull(), F.bitmap_bucket_number(at(tasks_key)))).join(F.broadcast(pieces), "__piece", "left")
    probed = probed.withColumn("__maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
    kept = [F.col(f"`{c}`") for c in tasks.columns]
    return probed.where(~F.col("__maybe")).select(*kept), probed.where("__maybe").select(*kept)


def skipped(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks run before, as results: successful, skipped, without latency."""
    found = tasks.join(done.select(key).distinct(), key, "left_semi")
    return found.withColumns({"success": F.lit(True), "skipped": F.lit(True), "latency": F.lit(0.0)})


def add(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids of either table, once each; null and empty ones dropped."""
    ids = done.select(F.col(key).cast("string").alias(key)).unionByName(new.select(F.col(key).cast("string").alias(key)))
    return ids.where(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def listed(done: DataFrame, key: str) -> DataFrame:
    """All ids as text, once each and sorted; null and empty ones dropped."""
    return add(done, done.limit(0), key).orderBy(key)


def counted(done: DataFrame, key: str) -> DataFrame:
    return add(done, done.limit(0), key).agg(F.count(F.lit(1)).alias("total"))
