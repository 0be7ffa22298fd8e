"""Finished tasks of a checkpoint that grows: small appends, merged now and then, with a manifest.

A folder holds ``added`` (what runs appended), ``merged`` (one folder for each merge) and
``manifest``.  A merge counts once its manifest, one file that is renamed into place, is
there; it names the merged folder and the appended files that went into it.  Readers take the
newest manifest's folder and every appended file that it doesn't name, so a merge that
dies changes nothing, appends made while one runs are kept, and of two merges at once one
wins and the other's files are still read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoint

KEY = "annotation_id"
_SCHEMA = f"{KEY} string"


def append(ids: DataFrame, path: str, key: str = KEY) -> None:
    """Adds ids; null and empty ones are dropped, and an append made again adds nothing to what readers see."""
    named = ids.select(F.col(key).cast("string").alias(KEY))
    named.where(F.coalesce(KEY, F.lit("")) != "").write.mode("append").parquet(f"{path}/added")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """All ids, once each; none if there is no such checkpoint."""
    return _rows(spark, path, *_state(spark, path)).distinct()


def merge(spark: SparkSession, path: str, files: int = 8) -> bool:
    """Writes all ids once each into a new folder of ``files`` files and then its manifest; False if nothing was appended since the last one."""
    version, folder, taken = _state(spark, path)
    new = sorted(set(_files(spark, f"{path}/added")) - taken)
    if not new:
        return False
    folder_of = f"{version + 1}-{uuid.uuid4().hex}"
    _rows(spark, path, version, folder, taken, new).distinct().repartition(files, KEY).write.parquet(f"{path}/merged/{folder_of}")
    _publish(spark, path, version + 1, folder_of, sorted(taken | set(new)))
    return True


def clean(spark: SparkSession, path: str) -> int:
    """Deletes merged folders that no manifest needs and appended files that were merged; how many of them.

    Only for times when nothing reads, appends or merges.  The driver sees names of files, never ids.
    """
    version, folder, taken = _state(spark, path)
    if folder is None:
        return 0
    kept = {folder}
    old = [f"{path}/merged/{name}" for name in _children(spark, f"{path}/merged") if name not in kept]
    there = set(_files(spark, f"{path}/added")) & taken
    for name in (*old, *there):
        _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(_path(spark, name), True)
    # A manifest of its own, as the newest one need not name files that are gone.
    _publish(spark, path, version + 1, folder, sorted(taken - there))
    return len(old) + len(there)


def pending(spark: SparkSession, tasks: DataFrame, path: str, key: str) -> DataFrame:
    """Tasks that the checkpoint doesn't hold; only those that its bitmap can't rule out are shuffled."""
    return checkpoint.pending_by_bitmap(tasks, finished(spark, path).withColumnRenamed(KEY, key), key)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _children(spark: SparkSession, folder: str) -> list[str]:
    at = _path(spark, folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Data files by full name."""
    return [f"{folder}/{n}" for n in _children(spark, folder) if n.endswith(".parquet")]


def _state(spark: SparkSession, path: str) -> tuple[int, str | None, set[str]]:
    """Version, folder and merged files of the newest manifest."""
    if not _files(spark, f"{path}/manifest"):
        return 0, None, set()
    best = spark.read.parquet(f"{path}/manifest").agg(F.max(F.struct("version", "folder", "files"))).first()[0]
    return best["version"], best["folder"], {f"{path}/added/{f}" for f in best["files"]}


def _publish(spark: SparkSession, path: str, version: int, folder: str, taken: list[str]) -> None:
    row = (version, folder, [f.rsplit("/", 1)[-1] for f in taken])
    spark.createDataFrame([row], "version long, folder string, files array<string>").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _rows(spark: SparkSession, path: str, version: int, folder: str | None, taken: set[str], new: list[str] | None = None) -> DataFrame:
    new = sorted(set(_files(spark, f"{path}/added")) - taken) if new is None else new
    sources = ([f"{path}/merged/{folder}"] if folder else []) + new
    return spark.read.schema(_SCHEMA).parquet(*sources) if sources else spark.createDataFrame([], _SCHEMA)
