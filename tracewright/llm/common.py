"""What several operators share: durable tables, folds and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a worker, in place of the 64 MB of Spark's default.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a batch are cut again so that no slice has more text than this.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for cut lineage.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and
    everything runs on one machine (a local master, as in tests) a temporary folder
    is chosen and set.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        set_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not set_dir and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of the session, which both sides hold in memory."""
    if spark.conf.get(BATCH_SETTING, None) is not None:  # known to this version of Spark
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    The lineage ends there: a lost executor costs a reread of the file, not a
    new computation, and Catalyst knows the table's real size.
    """
    spark = small_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that gives free memory back when its task ends:
    workers are used again, and what they hold on to counts against the executor."""

    @wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of bounded text size (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        if batch.num_rows == 0 or batch.column(at).nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, batch.num_rows * limit // batch.column(at).nbytes)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Column as Python strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class Bits:
    """A bitmap filter of fixed size over 64-bit hashes: no false negatives.

    It is built from distributed rows by an aggregation on its words, so the
    driver gets at most 2**BITS/64 words whatever the input's size, and a broadcast
    of 2**BITS/8 bytes.  Where the input is so large that the map fills up, it only
    lets more rows through to the exact step behind it.
    """

    BITS = 27

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __getstate__(self) -> tuple:
        """As broadcast: only the words that aren't 0, while they are the smaller part."""
        at = np.flatnonzero(self.words)
        return (len(self.words), at.astype(np.uint32), self.words[at]) if 2 * len(at) < len(self.words) else (len(self.words), None, self.words)

    def __setstate__(self, state: tuple) -> None:
        n, at, words = state
        self.words = words
        if at is not None:
            self.words = np.zeros(n, np.uint64)
            self.words[at] = words

    @classmethod
    def slot(cls, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - cls.BITS)

    def __contains__(self, h: np.ndarray) -> bool:
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        s = self.slot(h)
        return (self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) != 0

    SCHEMA = "word int, bits long"

    @classmethod
    def rows(cls, hashes: np.ndarray) -> pa.RecordBatch:
        """Hashes as the words of a bitmap that they set bits of."""
        s = cls.slot(hashes)
        word, at = np.unique(s >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (s & np.uint64(63)))
        return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    @classmethod
    def gathered(cls, rows: DataFrame) -> Bits:
        """From a DataFrame of such words."""
        got = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (cls.BITS - 6), np.uint64)
        words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
        return cls(words)

    @classmethod
    def of(cls, rows: DataFrame, key: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Bits:
        """From a DataFrame whose one column holds hashes as long, or whose batches
        ``key`` turns into hashes."""

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield cls.rows(key(b) if key else b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

        return cls.gathered(rows.mapInArrow(run, cls.SCHEMA))


def ordinal(doc_id: Column) -> Column:
    """Ids in order, null as the largest of all."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``docs`` whose ``on`` columns (nulls equal) are in no row of ``gone``.

    Both sides are told apart by a bitmap of the gone keys first, so only rows that
    may have to go are shuffled to the exact anti-join.  ``gone`` should be durable.
    """
    bits = docs.sparkSession.sparkContext.broadcast(Bits.of(gone.select(F.xxhash64(*on).alias("key"))))
    name = unused(docs, "key")
    keyed = docs.withColumn(name, F.xxhash64(*on))

    def side(wanted: bool):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                has = bits.value.has(b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64))
                yield b.filter(pa.array(has if wanted else ~has, pa.bool_()))

        return keyed.mapInArrow(run, keyed.schema).drop(name)

    asked, listed = side(True), gone.select(F.struct(*on).alias("gone"))
    same = [asked[c].eqNullSafe(listed["gone"][c]) for c in on]
    return side(False).unionByName(asked.join(listed, same, "left_anti"))
