"""N-gram Jaccard join with set-relation skipping.

Sets with equal shingles are one set.  A set that shares most min-hashes with an
earlier one joins that one's family, and is kept as its difference to the family's
representative: what it lacks and what it adds.  Two things follow from that
relation.

* Answers are derived.  With the overlap of set and representative known, a member
  is linked to it or not; two members a, b of one family overlap in
  ``|R| - lacks(a) - lacks(b) + |diff(a) & diff(b)|``, so their answer needs the small
  differences only, and most pairs are ruled out by prefixes of them.  Members of two
  families overlap in at most ``|R & S| + adds(a) + adds(b)``: the answer of the two
  representatives, computed once, rules out or decides all their members.
* Shared edits make stars, not squares.  Members that have an edit in common first
  meet one carrier of it; those it links are one component, and what is one
  component is never paired again.  So N copies with the same edits take N answers.
* Index lists (prefixes, frequent shingles last) are read by blocks.  A block is what
  one family has in a list and a size class, with the least and greatest position and
  size; two blocks whose positions leave too small an overlap are skipped unopened.

Blocks are opened only for families whose representatives leave room for a link,
and what is left is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bits, durable, ordinal, release, slices, tidy, unused, without
from .graph import components
from .hashing import U, mix, shingles

#: Min-hashes of a set; an earlier set must share this many to be a relative.
SKETCH, SHARED = 12, 7
#: Members less similar to their representative than this are families of their own.
KIN = 0.4
#: Frequent shingles in the order table: a broadcast of at most 16 bytes each.
FREQUENT = 1 << 18
#: Shingles that a worker gathers before it counts them.
GATHERED = 1_000_000
#: Bytes of text that a worker looks at together.
SLICE = 4 << 20
_SEEDS = np.random.default_rng(5).integers(1, 2**63, SKETCH, dtype=np.int64).view(U)


def linked(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in whole numbers."""
    return (100 + percent) * overlap >= percent * (a + b)


def prefix_length(n: int, percent: int) -> int:
    """Sets that link share an element among so many first ones of each, in any one order."""
    return n - -(-percent * n // 100) + 1


def _longs(x) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, U), *x]).view(np.int64))


def _lists(x: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), _longs(x))


def unpack(data: pa.Scalar) -> np.ndarray:
    """A set as it was written down: its sorted 64-bit hashes."""
    return np.frombuffer(data.as_buffer(), U)


def _half(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def place_of(digests: list[bytes], ords: np.ndarray) -> np.ndarray:
    """A hash of (set, id), to know a set's first row by."""
    return mix(np.array([_half(d) for d in digests], U) ^ mix(ords.view(U)))


def _keys(b: pa.RecordBatch) -> np.ndarray:
    """Rows (digest[, ord]) as hashes for a bitmap."""
    d = b.column(0).to_pylist()
    return place_of(d, b.column(1).to_numpy(zero_copy_only=False)) if b.num_columns > 1 else np.array([_half(x) for x in d], U)


class Order:
    """A total order of shingles: rare ones by hash, then the frequent by how often."""

    def __init__(self, token: np.ndarray, count: np.ndarray) -> None:
        at = np.argsort(token)
        self.token, self.level = token[at], np.log2(count[at]).astype(np.int64)

    def sorted(self, s: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return s
        k = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        level = np.where(self.token[k] == s, self.level[k], -1)
        return s[np.lexsort((s, level))]


def differences(batches: Iterator[pa.RecordBatch], percent: int, order: Order) -> Iterator[pa.RecordBatch]:
    """Rows (id, root, n, m, tokens, root's tokens) with the member's relation to its
    representative: lacks, adds, whether it is linked, the difference (added elements
    first, in the order of shingles, then lacking ones; the last bit tells them apart),
    and how long a prefix of it can meet an unlinked member (short) or, for an unlinked
    member itself, any other (long).

    With q = percent / (100 + percent), W = lacks + q * (n - m) and c = (1 - 2q) * m, a
    member is linked to the representative if W <= c, and a pair needs
    W(a) + W(b) - c common elements of the differences.  So a partner of an unlinked
    member needs more than its own W, and an unlinked one at least W - c + q, as any
    other member has W >= q.
    """
    q, whole = percent, 100 + percent
    for b in batches:
        cols = {k: [] for k in ("lacks", "adds", "diff", "short", "long")}
        for n, m, mine, theirs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
            x, y = unpack(mine), unpack(theirs)
            adds = order.sorted(np.setdiff1d(x, y, assume_unique=True))
            lacks = np.setdiff1d(y, x, assume_unique=True)
            w, c = whole * len(lacks) + q * (n - m), (100 - percent) * m  # times whole
            size = len(adds) + len(lacks)
            cols["lacks"].append(len(lacks))
            cols["adds"].append(len(adds))
            cols["diff"].append(np.concatenate([adds & ~U(1), lacks | U(1)]))
            cols["short"].append(max(0, size - w // whole))
            cols["long"].append(0 if w <= c else max(0, size - max(1, -(-(w - c + q) // whole)) + 1))
        ints = {k: pa.array(v, pa.int64()) for k, v in cols.items() if k != "diff"}
        yield pa.RecordBatch.from_arrays([*b.columns[:4], ints["lacks"], ints["adds"], _lists(cols["diff"]), ints["short"], ints["long"]], names=["id", "root", "n", "m", "lacks", "adds", "diff", "short", "long"])


def _star(these: DataFrame, those: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """``these`` with the columns of one row of ``those``, the greatest by ``rank``, for each ``key``."""
    carrier = F.struct(*(c for c in those.columns if c not in key))
    return these.join(those.groupBy(*key).agg(F.max_by(carrier, rank).alias("carrier")), key).select(*these.columns, "carrier.*")


def _across(these: DataFrame, those: DataFrame, key: list[str], links: DataFrame) -> DataFrame:
    """Pairs of equal ``key`` whose components (comp_a, comp_b) ``links`` leave apart.

    Keys that all have one component are dropped before the join.
    """
    if links.isEmpty():
        known = None
    else:
        known = durable(components(links, "merged"), "merged")

    def told(df: DataFrame, k: str) -> DataFrame:
        if known is None:
            return df.withColumn(f"now_{k}", F.col(f"comp_{k}"))
        now = known.select(F.col("node").alias(f"comp_{k}"), F.col("root").alias(f"now_{k}"))
        return df.join(now, f"comp_{k}", "left").withColumn(f"now_{k}", F.coalesce(f"now_{k}", f"comp_{k}"))

    a, b = told(these, "a"), told(those, "b")
    both = a.select(*key, F.col("now_a").alias("now")).unionByName(b.select(*key, F.col("now_b").alias("now")))
    mixed = both.groupBy(*key).agg(F.min("now").alias("least"), F.max("now").alias("most")).where("least < most").select(*key)
    return a.join(mixed, key).join(b, key).where(F.col("now_a") != F.col("now_b"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", tagged: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A set holds the distinct shingles of ``words`` words (A-Z lower-cased, split at
    ASCII white space); a shorter text is one shingle.  Rows link if their sets'
    Jaccard similarity is at least ``percent``/100; component_id is the smallest id
    reachable.  Texts without words (null, empty, blank) have no set and are linked
    with nothing: they keep their own id.  Null ids are the largest and stay null;
    repeated rows share one set.  All links between different sets are found; links
    inside a component are not all written out.  With ``tagged`` there is a column tag
    too, the xxhash64 of the text, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = docs.select(ordinal(F.col(id_col)).alias("ord"), F.col(text_col).cast("string").alias("text"))

    def sets(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """Id, key of the set (128 bits of its shingles), and the set, in order."""
        for o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = shingles((t or "").encode(), words)
            yield o, blake2b(s.tobytes(), digest_size=16).digest(), s

    kinds = [("ord", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64())), ("often", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]

    @tidy
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and now and then one with the shingles seen twice or more."""
        gathered: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate([np.zeros(0, U), *gathered]), return_counts=True)
            gathered.clear()
            many = count > 1
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for _, k in kinds[:5]), _lists([token[many]]), pa.array([count[many]], kinds[6][1])], names=[c for c, _ in kinds])

        for b in slices(batches, limit=SLICE):
            found = list(sets(b))
            sketch = [np.array([mix(s ^ x).min() for x in _SEEDS], U) if len(s) else np.zeros(0, U) for _, _, s in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for _, _, s in found], pa.int64()), pa.array([k if len(s) else None for _, k, s in found], pa.binary()), _lists(sketch), *(pa.nulls(len(found), k) for _, k in kinds[5:])],
                names=[c for c, _ in kinds],
            )
            gathered += [s for _, _, s in found]
            if sum(map(len, gathered)) > GATHERED:
                yield often()
        yield often()

    texts = text.withColumn("tag", F.xxhash64("text"))
    table = durable(texts.mapInArrow(sketches, "ord long, tag long, n long, digest binary, sketch array<long>, often array<long>, times array<long>"), "sets")
    rows = durable(table.where("ord is not null").select("ord", "tag", "n", "digest"), "rows")
    distinct = table.where("n > 0").groupBy("digest").agg(F.min("ord").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    distinct = durable(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")  # numbered once, as written
    firsts = sc.broadcast(Bits.of(distinct.select("digest", "first"), _keys))

    # The order: frequent shingles last.
    frequent = table.where("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("e")).groupBy(F.col("e.often").alias("token")).agg(F.sum("e.times").alias("k"))
    frequent = frequent.where("k > 2").orderBy(F.desc("k"), "token").limit(FREQUENT).toArrow()
    order = sc.broadcast(Order(frequent.column(0).to_numpy().view(U), frequent.column(1).to_numpy()))
    release(table)

    # Families: the relative of a set is the earliest of those that share most min-hashes with it.
    hashed = distinct.select("id", "first", F.posexplode("sketch").alias("i", "h"))
    me = F.struct("first", "id")
    groups = durable(hashed.groupBy("i", "h").agg(F.min(me).alias("leader"), F.max(me).alias("top")).where("leader < top").drop("top"), "groups")
    tried = hashed.join(groups, ["i", "h"]).where(F.col("leader") < me).groupBy("id", "leader").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED)
    parent = durable(tried.groupBy("id").agg(F.max_by("leader.id", F.struct("k", -F.col("leader.first"))).alias("root")), "parents")
    while True:  # pointer jumping: relatives are earlier, so chains end
        up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
        higher = durable(parent.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parents")
        release(parent)
        parent = higher
        if parent.where("moved").isEmpty():
            break
    kin = parent.select("id").unionByName(parent.select(F.col("root").alias("id")).distinct())
    known = distinct.select("digest", "id", "n").join(parent.select("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = durable(known, "known")
    related = sc.broadcast(Bits.of(known.join(kin, "id", "left_semi").select("digest"), _keys))

    def first_rows(b: pa.RecordBatch, wanted: Bits | None) -> Iterator[tuple[bytes, np.ndarray, bool]]:
        """The sets of rows that may be their set's first (a copy now and then, never none)."""
        found = [(o, k, s) for o, k, s in sets(b) if len(s)]
        here = firsts.value.has(place_of([k for _, k, _ in found], np.array([o for o, _, _ in found], np.int64)))
        also = wanted.has(np.array([_half(k) for _, k, _ in found], U)) if wanted else here
        return ((k, s, w) for (_, k, s), h, w in zip(found, here.tolist(), also.tolist(), strict=True) if h)

    @tidy
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            found = [(k, order.value.sorted(s)[: prefix_length(len(s), percent)], s.tobytes() if w else None) for k, s, w in first_rows(b, related.value)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.binary()), _lists([p for _, p, _ in found]), pa.array([t for _, _, t in found], pa.binary())], names=["digest", "prefix", "tokens"])

    leading = durable(text.mapInArrow(prefixes, "digest binary, prefix array<long>, tokens binary"), "prefixes")
    held = leading.where("tokens is not null").groupBy("digest").agg(F.first("tokens").alias("tokens")).join(known, "digest").drop("digest")
    held = durable(held, "held")

    # Members and their representatives: answers from the differences.
    top = held.where("id = root").select("root", F.col("n").alias("m"), F.col("tokens").alias("theirs"))
    compared = held.where("id <> root").join(top, "root").select("id", "root", "n", "m", "tokens", "theirs")
    relation = compared.mapInArrow(lambda x: differences(x, percent, order.value), "id long, root long, n long, m long, lacks long, adds long, diff array<long>, short long, long long")
    relation = durable(relation, "relations")
    overlap = F.col("m") - F.col("lacks")
    of_kin = relation.where(overlap >= KIN * (F.col("n") + F.col("m") - overlap)).withColumn("comp", F.when(linked(overlap, F.col("n"), F.col("m"), percent), F.col("root")).otherwise(F.col("id")))
    unlinked = of_kin.where("comp = id").select("root").distinct()  # families that need a look at their members
    inside = durable(of_kin.join(unlinked, "root", "left_semi"), "inside")

    def entries(length: str, k: str) -> DataFrame:
        e = inside.where(F.col(length) > 0).select("root", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "m", "lacks", "comp")), F.size("diff").alias(f"size_{k}"), (F.size("diff") - F.col(length)).alias(f"rest_{k}"), F.posexplode(F.slice("diff", 1, F.col(length).cast("int"))).alias(f"place_{k}", "e"))
        return durable(e, "entries")

    def needed(k: str = "m_a") -> Column:
        """Common elements of two differences that a link takes (times 100 + percent)."""
        return percent * (F.col("n_a") + F.col("n_b")) + (100 + percent) * (F.col("lacks_a") + F.col("lacks_b") - F.col(k))

    room = F.least("place_a", "place_b") + 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) - 1
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * room >= needed())
    ids = ["id_a", "id_b", "n_a", "n_b", "m_a", "lacks_a", "lacks_b", "comp_a", "comp_b", "rest_a", "rest_b"]
    diffs = lambda k: inside.select(F.col("id").alias(f"id_{k}"), F.col("diff").alias(f"diff_{k}"))
    common = F.size(F.array_intersect("diff_a", "diff_b"))

    def answered(pairs: DataFrame) -> DataFrame:
        """Components that linked members of one family join."""
        return pairs.join(diffs("a"), "id_a").join(diffs("b"), "id_b").where((100 + percent) * common >= needed()).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))

    # Shared edits: each has one carrier, the member with the smallest difference, and the
    # others that have it meet that one first.  What links so is one component, and
    # a shared edit of one component is not opened again.
    long, short, key = entries("long", "a"), entries("short", "b"), ["root", "e"]
    star = _star(long, short, key, F.struct(-F.col("size_b"), -F.col("id_b")))
    stars = durable(answered(durable(star.where((F.col("comp_a") != F.col("comp_b")) & fits).select(*ids).distinct(), "star")), "stars")
    met = _across(long, short, key, stars).where(fits)
    # What two prefixes share, and the rest of the one that ends first, bound what is common.
    met = met.groupBy(*ids).agg(F.count(F.lit(1)).alias("shared")).where((100 + percent) * (F.col("shared") + F.greatest("rest_a", "rest_b")) >= needed())
    met = durable(met, "met")
    links = durable(answered(met).unionByName(stars), "within")

    # All sets: family, component so far, added elements.
    told = of_kin.select("id", F.col("root").alias("family"), "comp", "adds")
    every = known.select("digest", "id", "n").join(told, "id", "left").select("digest", "id", "n", F.coalesce("family", "id").alias("root"), F.coalesce("comp", "id").alias("comp"), F.coalesce("adds", F.lit(0)).alias("adds"))
    every = durable(every, "every")
    twice = leading.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    listed = sc.broadcast(Bits.of(twice))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each prefix, the shingles that another has too, and their positions."""
        for b in batches:
            token, place = [], []
            for p in b.column(1):
                p = p.values.to_numpy().view(U)
                at = np.flatnonzero(listed.value.has(p))
                token.append(p[at])
                place.append(at.astype(U))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(token), _lists(place)], names=["digest", "token", "place"])

    kept = leading.select("digest", "prefix").mapInArrow(opened, "digest binary, token array<long>, place array<long>").where(F.size("token") > 0)
    kept = kept.groupBy("digest").agg(F.first(F.arrays_zip("token", "place")).alias("e")).join(every, "digest").select("id", "n", "root", F.explode("e").alias("e"))
    lists = kept.select("id", "n", "root", "e.token", "e.place").withColumn("block", F.floor(F.log("n") / F.lit(-np.log(percent / 100))))
    lists = durable(lists, "lists")
    release(leading)
    families = every.groupBy("root").agg(F.max((100 + percent) * F.col("adds") - percent * F.col("n")).alias("gain"), F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("id") == F.col("root"), F.col("n"))).alias("m"))
    families = durable(families, "families")
    blocks = lists.groupBy("token", "block", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("from"), F.max("place").alias("to"))
    blocks = durable(blocks, "blocks")
    side = lambda df, k: df.select("token", "block", *(F.col(c).alias(f"{c}_{k}") for c in ("root", "least", "most", "from", "to")))
    wide = blocks.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    reach = F.least("to_a", "to_b") + F.least(F.col("most_a") - F.col("from_a"), F.col("most_b") - F.col("from_b"))
    pairs = side(wide, "a").join(side(blocks, "b"), ["token", "block"]).where(
        (F.col("root_a") < F.col("root_b")) & linked(reach, F.col("least_a"), F.col("least_b"), percent) & (100 * F.least("most_a", "most_b") >= percent * F.greatest("least_a", "least_b"))
    )
    # As above: the shared part of two prefixes and the rest of one bound the overlap.
    spans = [F.max(F.greatest("most_a", "most_b")).alias("most"), F.min(F.col("least_a") + F.col("least_b")).alias("least")]
    pairs = pairs.groupBy(F.col("root_a").alias("a"), F.col("root_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), *spans)
    pairs = pairs.where((100 + percent) * (F.col("shared") + F.ceil(percent * F.col("most") / 100) - 1) >= percent * F.col("least"))
    pairs = durable(pairs.select("a", "b"), "pairs")

    # Packed sets: members and representatives have theirs; single sets of pairs are read again.
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    have = held.select("id", "tokens")
    asked = durable(known.select("digest", "id").join(ends, "id", "left_semi").join(have.select("id"), "id", "left_anti"), "asked")
    single = sc.broadcast(Bits.of(asked.select("digest"), _keys))

    @tidy
    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            found = [(k, s.tobytes()) for k, s, w in first_rows(b, single.value) if w]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([t for _, t in found], pa.binary())], names=["digest", "tokens"])

    more = text.mapInArrow(shown, "digest binary, tokens binary").groupBy("digest").agg(F.first("tokens").alias("tokens")).join(asked, "digest").select("id", "tokens")
    packed = durable(have.unionByName(more), "tokens")

    def overlaps(these: DataFrame, keep: list[str]) -> DataFrame:
        """``these`` (id_a, id_b, ...) with the exact size of the intersection."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = [len(np.intersect1d(unpack(x), unpack(y), assume_unique=True)) for x, y in zip(b.column(0), b.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(size, pa.int64())], names=[*keep, "overlap"])

        of = lambda k: packed.select(F.col("id").alias(f"id_{k}"), F.col("tokens").alias(f"t_{k}"))
        both = these.join(of("a"), "id_a").join(of("b"), "id_b").select("t_a", "t_b", *keep)
        return both.mapInArrow(count, ", ".join(f"{c} long" for c in [*keep, "overlap"]))

    sized = pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    met = durable(overlaps(sized, ["id_a", "id_b"]), "answers")
    family = lambda k: families.select(F.col("root").alias(f"id_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("gain", "k", "m")))
    answer = durable(met.join(family("a"), "id_a").join(family("b"), "id_b"), "answers")
    first = answer.where(linked(F.col("overlap"), F.col("m_a"), F.col("m_b"), percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    # Members: only where the representatives' overlap and what members add leave room.
    spare = answer.where(((F.col("k_a") > 1) | (F.col("k_b") > 1)) & ((100 + percent) * F.col("overlap") + F.col("gain_a") + F.col("gain_b") >= 0))
    spare = durable(spare.select("id_a", "id_b", "overlap", *(f"{c}_{k}" for c in ("gain", "k", "m") for k in "ab")), "spare")
    gain = (100 + percent) * F.col("adds") - percent * F.col("n")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def survivors(k: str, other: str) -> DataFrame:
        """Members of one side of those pairs that some member of the other may be linked to."""
        here = spare.select(F.col(f"id_{k}").alias("root"), F.col(f"id_{other}").alias("far"), "overlap", F.col(f"gain_{other}").alias("help"), F.col(f"k_{k}").alias("own"), F.col(f"k_{other}").alias("many"), F.col(f"m_{other}").alias("n_far")).where("own > 1")
        fit = every.join(here, "root").where(((100 + percent) * F.col("overlap") + F.col("help") + gain >= 0) & alike(F.col("n"), F.when(F.col("many") == 1, F.col("n_far")).otherwise(F.col("n"))))
        return durable(fit.select("root", "far", "id", "n", "comp", gain.alias("gain"), "overlap", "many", "n_far"), "survivors")

    def to_single(fit: DataFrame) -> DataFrame:
        """Pairs of a member and a set that has no relatives: the representatives' answer decides all but these."""
        return fit.where("many = 1 and comp <> far").select(F.col("id").alias("id_a"), F.col("far").alias("id_b"), F.col("n").alias("n_a"), F.col("n_far").alias("n_b"), F.col("comp").alias("comp_a"), F.col("far").alias("comp_b"))

    def opened_lists(fit: DataFrame, k: str) -> DataFrame:
        pair = [F.col("root" if k == "a" else "far").alias("root_a"), F.col("far" if k == "a" else "root").alias("root_b")]
        fit = fit.where("many > 1").join(lists.select("id", "token", "place"), "id")
        return fit.select(*pair, "token", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "comp", "place", "gain")), *(["overlap"] if k == "a" else []))

    na, nb = F.col("n_a"), F.col("n_b")
    bound = F.least("place_a", "place_b") + F.least(na - F.col("place_a"), nb - F.col("place_b"))
    one, two = survivors("a", "b"), survivors("b", "a")
    keep = ["n_a", "n_b", "comp_a", "comp_b"]
    found = lambda pairs: overlaps(pairs, keep).where(linked(F.col("overlap"), na, nb, percent)).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    near_a, near_b, key = durable(opened_lists(one, "a"), "near"), durable(opened_lists(two, "b"), "near"), ["root_a", "root_b", "token"]
    fits = ((100 + percent) * F.col("overlap") + F.col("gain_a") + F.col("gain_b") >= 0) & alike(na, nb) & linked(bound, na, nb, percent)
    # As inside families: a list's carriers first, one for each side, then what they leave apart.
    star = _star(near_a, near_b, key, F.struct("gain_b", "id_b")).unionByName(_star(near_b, near_a, key, F.struct("gain_a", "id_a")))
    star = star.where((F.col("comp_a") != F.col("comp_b")) & fits).select("id_a", "id_b", *keep).distinct()
    star = durable(star.unionByName(to_single(one)).unionByName(to_single(two)), "star")
    across = durable(links.unionByName(first).unionByName(found(star)), "across")
    if not near_a.isEmpty():
        open_pairs = durable(_across(near_a, near_b, key, across).where(fits).select("id_a", "id_b", *keep).distinct(), "open")
        across = durable(across.unionByName(found(open_pairs)), "across")
        release(open_pairs)
    roots = durable(components(across, "cc"), "roots")

    joined = distinct.select("id", "first").join(every.select("digest", "id", "comp"), "id")
    joined = joined.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left").select("digest", "first", F.coalesce("root", "comp").alias("root"))
    joined = durable(joined, "rooted")
    least = durable(joined.groupBy("root").agg(F.min("first").alias("component")), "least")
    named = durable(joined.join(least, "root").select("digest", "component"), "named")
    release(distinct, groups, parent, known, held, relation, inside, links, every, lists, families, blocks, pairs, asked, packed, met, answer, spare, one, two, long, short, stars, near_a, near_b, star, across, roots, joined, least)
    for b in (firsts, order, related, listed, single):
        b.destroy()
    out = rows.join(named, "digest", "left")
    kind = docs.schema[id_col].dataType
    as_id = lambda c: F.when(c < 2**63 - 1, c).cast(kind)
    return out.select(as_id(F.col("ord")).alias("doc_id"), F.col("n").alias("n_shingles"), as_id(F.coalesce("component", "ord")).alias("component_id"), *(["tag"] if tagged else []))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) without those that share a component with
    a smaller id.  Rows without words stay, and rows that repeat the smallest id do.

    Rows are told by id and a hash of their text, so null and repeated ids are judged
    row by row; the rows that go are known from a narrow table, and no other text is
    shuffled.
    """
    member = jaccard_components(docs, words, percent, tagged=True)
    name = unused(docs, "tag")
    gone = member.where("n_shingles > 0 and component_id < coalesce(cast(doc_id as bigint), 9223372036854775807)")
    gone = durable(gone.select("doc_id", F.col("tag").alias(name)).distinct(), "gone")
    keyed = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    return without(keyed, gone, ["doc_id", name]).drop(name)
