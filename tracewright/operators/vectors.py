"""Exact nearest vectors by cosine: rows lie in clusters, and a query meets only those that can hold an answer.

Angles obey the triangle inequality, so no row of a cluster is closer to a query than the
query is to the cluster's pivot, less the cluster's radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_candidates

#: Pivots at most; rows and queries that meet in one group, about; similarities computed at once.
PIVOTS, ROWS, QUERIES, CELLS = 256, 4_096, 1_024, 2_000_000

#: What rounding may add to an angle; clusters within it are met, not left out.
SLACK = 1e-6


def nearest_in_clusters(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score and rank of the k rows most similar to each query by cosine, without itself.

    The lower id wins ties.  Vectors that are null, empty, zero, not finite or hold a null,
    and rows without an id, have no similarity; nor have vectors of different lengths.
    An id and vector that stand in several rows count once.

    Pivots are the rows of the smallest hashes; the driver gets them and a size and radius
    for each, whatever the table's size.  Queries meet their own cluster first; its k-th
    score is the floor that leaves other clusters out.  Groups that meet are cut by hash to
    about ROWS and QUERIES, so a cluster of any size is spread over tasks.
    """
    spark = rows.sparkSession
    table, asked = _vectors(rows, id_col, vector), _vectors(queries, id_col, vector)
    pivots = _usable([r["embedding"] for r in table.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()])
    sent = spark.sparkContext.broadcast(pivots)

    placed, asked = table.mapInArrow(_placing(sent), _PLACED), asked.mapInArrow(_placing(sent), _PLACED)
    sizes, radius = [0] * (PIVOTS + 1), [0.0] * (PIVOTS + 1)  # cluster -1, of lengths without a pivot, comes last
    for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
        sizes[r["cluster"]], radius[r["cluster"]] = r["n"], r["r"]
    blocks = [-(-n // ROWS) for n in sizes]

    first = _meet(placed, asked, blocks, k)
    near = top_candidates(first, "query_id", k, "score", "vec_id").persist()
    floors = near.where(F.col("rank") == k - 1).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    visits = asked.join(floors, "id", "left").select("id", "embedding", "cluster", "floor").mapInArrow(_visiting(sent, sizes, radius), _VISITS)
    rest = _meet(placed, visits, blocks, k)
    return top_candidates(near.drop("rank").unionByName(rest), "query_id", k, "score", "vec_id")


_PLACED = "id long, embedding array<double>, cluster int, angle double"
_VISITS = "id long, embedding array<double>, cluster int"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col("embedding")
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
    return out.where(F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())).dropDuplicates(["id", "embedding"])


def _of(values: list[int], cluster: str) -> Column:
    """A cluster's entry; the one of -1 is the last."""
    return F.element_at(F.lit(values), F.when(F.col(cluster) < 0, F.lit(-1)).otherwise(F.col(cluster) + 1))


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):  # in this order for each row, so equal vectors tie
        total += x[:, d] * x[:, d]
    return np.sqrt(total)


def _usable(vectors: list[list[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length its pivots: their numbers and unit vectors, equal ones once."""
    lengths: dict[int, list[tuple[int, np.ndarray]]] = {}
    for n, v in enumerate(dict.fromkeys(map(tuple, vectors))):
        x = np.array([v])
        with np.errstate(over="ignore", invalid="ignore"):
            norm = _norms(x)[0]
        if 0 < norm < np.inf:
            lengths.setdefault(len(v), []).append((n, x[0] / norm))
    return [(np.array([n for n, _ in some], np.int32), np.stack([u for _, u in some])) for some in lengths.values()]


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length, without those that have no direction."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = _norms(x)
        good = (norm > 0) & np.isfinite(norm)
        if good.any():
            yield at[good], x[good]


def _cosines(x: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Summed in one order, so a row computed again in another batch keeps its cluster."""
    c = np.zeros((len(x), len(units)))
    for d in range(x.shape[1]):
        c += x[:, d, None] * units[None, :, d]
    return np.clip(c / _norms(x)[:, None], -1.0, 1.0)


def _placing(sent) -> Callable:
    """Each vector's closest pivot and its angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = {units.shape[1]: (names, units) for names, units in sent.value}
        for b in batches:
            for at, x in _by_length(b.column("embedding")):
                cluster, angle = np.full(len(x), -1, np.int32), np.full(len(x), np.pi)
                if x.shape[1] in pivots:
                    names, units = pivots[x.shape[1]]
                    c = _cosines(x, units)
                    best = c.argmax(axis=1)
                    cluster, angle = names[best], np.arccos(c[np.arange(len(x)), best])
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), pa.array(cluster, pa.int32()), pa.array(angle)], names=["id", "embedding", "cluster", "angle"])

    return run


def _visiting(sent, sizes: list[int], radius: list[float]) -> Callable:
    """Each query once for each cluster but its own that may hold a row not below its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = {units.shape[1]: (names, units) for names, units in sent.value}
        for b in batches:
            own = b.column("cluster").to_numpy()
            floor = b.column("floor").to_numpy(zero_copy_only=False).astype(float)
            for at, x in _by_length(b.column("embedding")):
                if x.shape[1] not in pivots:
                    continue
                names, units = pivots[x.shape[1]]
                widest = np.where(np.isnan(floor[at]), np.pi, np.arccos(np.clip(floor[at], -1.0, 1.0)))
                reach = np.arccos(_cosines(x, units)) - np.array([radius[n] for n in names])[None, :]
                go = (reach <= widest[:, None] + SLACK) & (names[None, :] != own[at][:, None]) & (np.array([sizes[n] for n in names]) > 0)[None, :]
                q, p = np.nonzero(go)
                part = b.take(pa.array(at[q]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("embedding"), pa.array(names[p], pa.int32())], names=["id", "embedding", "cluster"])

    return run


def _meet(placed: DataFrame, asked: DataFrame, blocks: list[int], k: int) -> DataFrame:
    """The k best rows of each group for each of its queries; queries and rows of a cluster meet block by block."""
    counts = {r["cluster"]: r["count"] for r in asked.groupBy("cluster").count().collect()}  # one for each pivot at most
    parts = [-(-counts.get(c, 0) // QUERIES) for c in (*range(PIVOTS), -1)]
    each = lambda n, name: F.explode(F.sequence(F.lit(0), n - 1)).alias(name)
    cut = lambda n, *of: F.pmod(F.xxhash64(*of), n).cast("int")
    part, block = _of(parts, "cluster"), _of(blocks, "cluster")
    left = asked.where(block > 0).select("cluster", cut(part, "id", "embedding").alias("part"), each(block, "block"), "id", "embedding")
    right = placed.where(part > 0).select("cluster", each(part, "part"), cut(block, "id", "embedding").alias("block"), "id", "embedding")

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        sides = {x.shape[1]: (at, x) for at, x in _by_length(held["embedding"])} if held.num_rows else {}
        for at, q in _by_length(asking["embedding"]) if sides and asking.num_rows else ():
            if q.shape[1] in sides:
                there, x = sides[q.shape[1]]
                out.append(_best(asking["id"].to_numpy()[at], q, held["id"].to_numpy()[there], x, k))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    keys = ["cluster", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.Table:
    best, found = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
    norm, step = _norms(q)[:, None], max(1, CELLS // len(q))
    for at in range(0, len(x), step):
        y, some = x[at : at + step], ids[at : at + step]
        c = np.zeros((len(q), len(y)))
        for d in range(x.shape[1]):
            c += q[:, d, None] * y[None, :, d]
        c /= norm * _norms(y)[None, :]
        c[~np.isfinite(c) | (names[:, None] == some[None, :])] = -np.inf
        best, found = np.hstack([best, c]), np.hstack([found, np.broadcast_to(some, c.shape)])
        keep = np.lexsort((found, -best), axis=1)[:, :k]
        best, found = np.take_along_axis(best, keep, 1), np.take_along_axis(found, keep, 1)
    good = np.isfinite(best)
    return pa.table([np.broadcast_to(names[:, None], best.shape)[good], found[good], best[good]], schema=_FOUND)
