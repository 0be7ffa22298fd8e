"""Merkle manifest of a dataset: roots, and a proof and a check for every row.

Leaves are ranked within their group by one range shuffle of digests and packed in
blocks of FAN**height consecutive ones, which tasks reduce each on its own.  Only the
blocks' nodes reach the driver (at most TOP and one for each group).  It builds the
upper tree and broadcasts it: a block's suffix path is a slice of its levels.  Tasks
then finish proofs and folds in one narrow pass over the packed blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release, tidy

#: Children of a node.
FAN = 16
#: Nodes of an upper tree that the driver builds and broadcasts, at most; beyond it
#: blocks are higher, and more groups than this get a distributed tree of their own.
TOP = 1 << 16
#: Rows of an executor's output batch.
ROWS = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def node(children: bytes) -> bytes:
    return sha256(children).hexdigest().encode()


def climb(level: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """The levels over ``level``: ``height`` of them, or until one node is left."""
    levels = [level]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        at = levels[-1]
        levels.append([node(b"".join(at[i : i + FAN])) for i in range(0, len(at), FAN)])
    return levels


def path(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of node i in its run, level by level."""
    out = []
    for level in levels[:-1]:
        run, at = level[i - i % FAN : i - i % FAN + FAN], i % FAN
        out.append((b"".join(run[:at]), b"".join(run[at + 1 :])))
        i //= FAN
    return out


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place in its group ``grp`` by ``order``; durable.

    One range shuffle sorts; a partition numbers its groups' rows from 0.  Only the
    first group of a partition can have begun before it, so the offsets to add are at
    most one for each partition, and those are broadcast.
    """
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order]

    @tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, groups = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode()
            code = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(starts, b.num_rows))
            pos = np.arange(b.num_rows) - np.repeat(starts, size)
            first = b.column(0)[0].as_py()
            same = groups and first == last
            if same:
                pos[: size[0]] += count
            run = groups - 1 + (0 if same else 1) + np.repeat(np.arange(len(starts)), size)
            groups, last, count = int(run[-1]) + 1, b.column(0)[-1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos), pa.array(run == 0), pa.array(np.full(b.num_rows, part))], names=[*b.schema.names, "place", "opens", "part"])

    sorted_ = leaves.select("grp", *[c for c in leaves.columns if c != "grp"]).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema)
    table = durable(sorted_.mapInArrow(number, f"{fields}, place long, opens boolean, part long"), "ranked")
    sums = table.groupBy("grp", "part").agg((F.max("place") + 1).alias("n"))
    before = sums.selectExpr("grp", "part", "sum(n) over (partition by grp order by part rows between unbounded preceding and 1 preceding) as before")
    offsets = durable(before.where("before > 0").select("part", "before"), "offsets")
    out = table.join(F.broadcast(offsets), "part", "left").withColumn("pos", F.col("place") + F.when(F.col("opens"), F.coalesce("before", F.lit(0))).otherwise(0))
    out = out.drop("part", "place", "opens", "before")
    out.built_on = (table, offsets)
    return out


def height_of(rows: int, top: int) -> int:
    """The least height, 2 at least, at which ``rows`` leaves have at most ``top`` full blocks."""
    height = 2
    while rows // FAN**height > top:
        height += 1
    return height


def packed(rows: DataFrame, height: int, payload: str) -> DataFrame:
    """One row for each block of a group: its leaves in order, its node at ``height``
    and (``alone``) the node where a group of this one block ends; durable.

    A task holds one block, FAN**height digests.
    """

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        leaves = [x.encode() for x in block["leaf"].to_pylist()]
        names = ["grp", "block", "leaves", "node", "alone", payload, "tampered"]
        values = [block["grp"][0].as_py(), block["block"][0].as_py(), b"".join(leaves), climb(leaves, height)[-1][0], climb(leaves)[-1][0], block[payload].to_pylist(), block["tampered"].to_pylist()]
        types = [block.schema.field("grp").type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(block.schema.field(payload).type), pa.list_(pa.string())]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"grp {kind['grp']}, block long, leaves binary, node binary, alone binary, `{payload}` array<{kind[payload]}>, tampered array<string>"
    blocks = rows.withColumn("block", F.floor(F.col("pos") / FAN**height).cast("long")).groupBy("grp", "block").applyInArrow(pack, schema)
    return durable(blocks, "blocks")


class Upper:
    """The tree over blocks and groups: what is broadcast."""

    def __init__(self, nodes: list[dict]) -> None:
        by: dict = {}
        for r in sorted(nodes, key=lambda r: r["block"]):
            by.setdefault(r["grp"], []).append(r)
        self.groups = sorted(by, key=lambda g: (g is not None, str(g).encode()))
        self.levels = {g: climb([r["node"] for r in by[g]]) if len(by[g]) > 1 else [[by[g][0]["alone"]]] for g in self.groups}
        self.rank = {g: i for i, g in enumerate(self.groups)}
        self.over = climb([self.levels[g][-1][0] for g in self.groups])

    def suffix(self, grp, block: int) -> tuple[bytes, bytes, list[tuple[bytes, bytes]]]:
        """Subroot, root and the path from a block's node to the root."""
        levels = self.levels[grp]
        return levels[-1][0], self.over[-1][0], path(levels, block) + path(self.over, self.rank[grp])


def finished(blocks: DataFrame, upper, height: int, payload: str, given: bool) -> DataFrame:
    """Each row's path, proof and fold from its block and the block's suffix path.

    The suffix comes from the broadcast ``upper`` tree or, if ``given``, from the
    block's own columns subroot, root and suffix.
    """
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}[payload]
    element = kind[len("array<") : -1]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                hexes = r["leaves"]
                leaves = [hexes[i : i + 64] for i in range(0, len(hexes), 64)]
                if given:
                    subroot, root, suffix, several = r["subroot"], r["root"], [(s["l"], s["r"]) for s in r["suffix"]], r["several"]
                else:
                    subroot, root, suffix = upper.value.suffix(r["grp"], r["block"])
                    several = len(upper.value.levels[r["grp"]]) > 1
                levels = climb(leaves, height) if several else climb(leaves)
                tail = b"".join(x for pair in suffix for x in pair)
                for start in range(0, len(leaves), ROWS):
                    proofs, folds = [], []
                    for i in range(start, min(start + ROWS, len(leaves))):
                        near = path(levels, i)
                        proofs.append(sha256(b"".join(x for pair in near for x in pair) + tail).hexdigest())
                        at = (r["tampered"][i] or "").encode() or leaves[i]
                        for left, right in near + suffix:
                            at = node(left + at + right)
                        folds.append(at.decode())
                    n = len(proofs)
                    root_, part = root.decode(), hexes[64 * start : 64 * (start + n)].decode()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(r[payload][start : start + n], b.schema.field(payload).type.value_type),
                            pa.array([part[64 * i : 64 * i + 64] for i in range(n)]),
                            pa.array([subroot.decode()] * n),
                            pa.array([root_] * n),
                            pa.array(proofs),
                            pa.array(folds),
                            pa.array([f == root_ for f in folds]),
                        ],
                        names=[payload, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                    )

    return blocks.mapInArrow(run, f"`{payload}` {element}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def group_paths(blocks: DataFrame, height: int, top: int) -> DataFrame:
    """``blocks`` with subroot, root and suffix of each, for more groups than the driver may hold.

    Only groups of several blocks have upper levels of their own, at most ``top`` nodes
    and ``top`` groups' first ones: those the driver builds.  The tree over all
    groups is reduced in blocks like rows are; its paths are joined to groups by name.
    """
    spark = blocks.sparkSession
    several = blocks.where("block > 0").select(F.struct("grp").alias("g")).distinct()
    many = blocks.join(F.broadcast(several), F.col("grp").eqNullSafe(F.col("g.grp")), "left_semi").select("grp", "block", "node", "alone")
    inner = Upper(many.toArrow().to_pylist())
    within = [(g, b, [{"l": le, "r": ri} for le, ri in path(lv, b)]) for g, lv in inner.levels.items() for b in range(len(lv[0]))]
    kind = dict(blocks.dtypes)["grp"]
    pairs = "array<struct<l:binary,r:binary>>"
    own = durable(spark.createDataFrame([(str(g) if g is not None else None, b, p) for g, b, p in within], f"g string, b long, near {pairs}"), "near")
    roots = spark.createDataFrame([(g, lv[-1][0].decode()) for g, lv in inner.levels.items()], f"grp {kind}, leaf string")
    alone = blocks.join(F.broadcast(several), F.col("grp").eqNullSafe(F.col("g.grp")), "left_anti").select("grp", F.col("alone").cast("string").alias("leaf"))
    subroots = alone.unionByName(roots).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "leaf", F.lit(None).cast("string").alias("tampered"))
    over = ranked(subroots, ["name"])
    tall = height_of(over.count(), top)
    upper_blocks = packed(over, tall, "name")
    upper = Upper(upper_blocks.select("grp", "block", "node", "alone").toArrow().to_pylist())
    shared = spark.sparkContext.broadcast(upper)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                leaves = [r["leaves"][i : i + 64] for i in range(0, len(r["leaves"]), 64)]
                _, root, suffix = shared.value.suffix(r["grp"], r["block"])
                levels = climb(leaves, tall if len(shared.value.levels[r["grp"]]) > 1 else None)
                for start in range(0, len(leaves), ROWS):
                    ids = range(start, min(start + ROWS, len(leaves)))
                    far = [[{"l": le, "r": ri} for le, ri in path(levels, i) + suffix] for i in ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["name"][i] for i in ids], b.schema.field("name").type.value_type), pa.array([leaves[i] for i in ids]), pa.array([root] * len(ids)), pa.array(far, pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())])))],
                        names=["name", "subroot", "root", "far"],
                    )

    paths = durable(upper_blocks.mapInArrow(run, f"name {kind}, subroot binary, root binary, far {pairs}"), "paths")
    out = blocks.join(F.broadcast(own), F.col("grp").cast("string").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")), "left")
    out = out.join(paths, F.col("grp").eqNullSafe(F.col("name")))
    empty = F.array().cast(pairs)
    return out.withColumn("several", F.col("near").isNotNull()).withColumn("suffix", F.concat(F.coalesce("near", empty), "far")).drop("g", "b", "near", "name", "far")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tamper: Column | None = None, top: int = TOP) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified.

    ``columns`` are id, group, any others and the text, as they enter the leaf; ids
    ascend within a group (null first, ties by leaf, equal rows at places of their own),
    groups by their UTF-8 bytes, null first.  ``tamper`` tells the rows whose fold
    starts from a leaf with the text's A-Z lower-cased: by default those whose id's
    crc32 5 divides.  Nulls enter a leaf as ``-``, so a null text and an empty one
    differ; a null id is never tampered with.  Other columns are not read.  An empty
    table gives no rows and has no root.

    Two shuffles of digests, none of texts; the driver gets at most ``top`` block nodes
    and one for each group, or where groups alone are more, builds only the upper parts.
    """
    id_col, group_col, text_col = columns[0], columns[1], columns[-1]
    if tamper is None:
        tamper = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    low = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    cols = [F.col(c) for c in columns]
    leaves = docs.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(id_col).alias("doc_id"),
        leaf(cols).alias("leaf"),
        F.when(tamper, leaf([*cols[:-1], low])).alias("tampered"),
    )
    rows = ranked(leaves, ["doc_id", "leaf"])
    height = height_of(rows.built_on[0].count(), top)
    blocks = packed(rows, height, "doc_id")
    release(*rows.built_on)
    if blocks.where("block = 0").count() > top:
        return finished(group_paths(blocks, height, top), None, height, "doc_id", given=True)
    upper = Upper(blocks.select("grp", "block", "node", "alone").toArrow().to_pylist())
    return finished(blocks, docs.sparkSession.sparkContext.broadcast(upper), height, "doc_id", given=False)
