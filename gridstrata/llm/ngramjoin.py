"""N-gram Jaccard join: tiles by size, hashed bitmaps, exact sorted-array intersection; components of the links.

A document's set holds the hashes of its distinct shingles of five words. Equal sets form one class, so copies cost one row.
Two classes that link share a shingle among the first `size - ceil(0.75 * size) + 1` of each set, in any one order of all
shingles; ours puts the corpus's most frequent shingles last, rarer ones first among them, so that common passages make no
groups. A shingle's place in that order bounds the sizes that its set can link with by it; classes that a shingle has and
whose sizes it lets link name the smallest of them as their leader, and the classes that a leader gathers form one block: every
pair that may link by a shingle meets in the block of a leader.

Blocks are settled twice. First by bitmaps, whose width follows the size of a set (2 to 4 bits a shingle, a wider one is
folded to its neighbour's width): bit counts bound the overlap from above, and each block returns a spanning forest of the
pairs that the bound allows. The components of these forests are the new, smaller groups, and each class is in one of them, so
that its whole set is sent once. There exact intersections of sorted arrays settle which classes link. A group of more
than TILE_CLASSES classes or TILE_SHINGLES shingles is cut into tiles by size band and hash: tiles are settled each for
itself, then one representative of each component of a tile meets the others, and only what is still in different components
meets in pairs of tiles whose sizes can link. So a large group of near copies costs about one pass over its members. A
group of many texts that share much and yet do not link costs the square of its number of tiles; nothing is capped.

Texts are hashed twice (sizes, classes and frequencies; then prefixes and bitmaps), those of candidates a third time. Tables
in the shared folder are dropped as soon as their successor is written.

Shingle hashes, class ids and the hashes of texts that spare a task the copies it has seen have 64 bits: two of k values
collide with odds of about k^2 / 2^65. Null or empty texts and texts of white space have the empty set, link with nothing, and
are their own components. Rows that repeat a doc_id are copies or links like any others. A null doc_id is never a component's
id unless there is no other. Other columns of the documents are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.llm.common import drop, written

WORDS = 5
#: Link when DEN * intersection >= NUM * (sum of both sizes): 0.75 of the union.
NUM, DEN = 3, 7
#: Buckets of the corpus-wide count of shingles, the same in blocks, and how many standard deviations above the mean make a
#: bucket crowded. They decide the order of shingles only, never a result.
BUCKETS, BLOCKS, SIGMAS = 1 << 20, 256, 6
#: Classes and shingles of a tile; sizes of a band differ by less than this factor, so links stay in a band or the next.
TILE_CLASSES, TILE_SHINGLES, BAND = 2048, 1 << 20, 1.34
#: Components of at least so many members in a group have tiles of their own when tiles meet.
OWN_TILES = 64
#: Candidates are found in the corpus by a broadcast filter up to this number (8 MB then), and by a join beyond it.
FILTER_MOST = 1 << 22


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: bytes.split and bytes.lower know ASCII only, as the definition does."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def class_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def bucket(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(40)).astype(np.int64) % BUCKETS


class Counts:
    """Shingles of each bucket."""

    def __init__(self):
        self.total, self.held, self.size = np.zeros(BUCKETS, np.int64), [], 0

    def add(self, own: np.ndarray) -> None:
        self.held.append(own)
        self.size += len(own)
        if self.size >= BUCKETS // 4:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.total += np.bincount(bucket(np.concatenate(self.held)), minlength=BUCKETS)
            self.held, self.size = [], 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Number and packed counts of each block that has any."""
        self.flush()
        for k, part in enumerate(self.total.reshape(BLOCKS, -1)):
            if part.any():
                yield k, zlib.compress(part.tobytes(), 1)


def prefix(own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that it must share one of: the first in order of (level of the bucket, hash), as those of level 0
    and those of crowded buckets."""
    n = len(own)
    most = n - -(-3 * n // 4) + 1
    of = level[bucket(own)]
    early, late = own[of == 0][:most], np.flatnonzero(of)
    return early, own[late[np.argsort(of[late], kind="stable")]][: most - len(early)]


def bitmap(own: np.ndarray) -> bytes:
    """One bit for each shingle, by its hash; the width is a power of two from two bits a shingle on."""
    width = max(64, 1 << (2 * len(own) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[own % np.uint64(width)] = 1
    return np.packbits(bits).tobytes()


class Maps:
    """Bitmaps of several widths, compared at the smaller of two."""

    def __init__(self, maps: list[bytes]):
        self.width, self.row = np.array([len(m) for m in maps]), np.empty(len(maps), np.int64)
        self.own, self.half = {}, {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            rows = np.frombuffer(b"".join(maps[i] for i in at), np.uint8).reshape(len(at), w)
            self.own[w] = rows.view(np.uint64)
            if w > 8:
                self.half[w] = (rows[:, : w // 2] | rows[:, w // 2 :]).view(np.uint64)

    def alone(self, x: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of x that each of `near` lacks, and of each that x lacks."""
        w, widths = int(self.width[x]), self.width[near]
        out = np.empty((2, len(near)), np.int64)
        for v in {w // 2, w, 2 * w} & set(self.own):
            at = np.flatnonzero(widths == v)
            if len(at):
                a = (self.half if v < w else self.own)[w][self.row[x]]
                b = (self.half if v > w else self.own)[v][self.row[near[at]]]
                out[0, at] = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
                out[1, at] = np.bitwise_count(~a & b).sum(axis=1, dtype=np.int64)
        return out[0], out[1]


def bounded(x: int, left: np.ndarray, sizes: np.ndarray, maps: Maps) -> np.ndarray:
    """Those of `left` whose sizes and bit counts allow a link with x; sizes rise along `left`."""
    own = sizes[left]
    near = left[np.searchsorted(own, -(-3 * sizes[x] // 4)) : np.searchsorted(own, 4 * sizes[x] // 3, "right")]
    if not len(near):
        return near
    # a bit of one map that the other lacks is a shingle, or more, that the other lacks
    alone_x, alone_y = maps.alone(x, near)
    most = np.minimum(sizes[x] - alone_x, sizes[near] - alone_y)
    return near[DEN * most >= NUM * (sizes[x] + sizes[near])]


def linked(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sets link with x, by exact intersection of sorted arrays."""
    flat, sizes = np.concatenate(others), np.array([len(o) for o in others])
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    common = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return DEN * common >= NUM * (len(x) + sizes)


def forest(ids: list[int], sizes: list[int], maps: list[bytes], sets: list[np.ndarray] | None = None, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected: each component's members with one of them. Without sets, what bitmaps allow counts
    as a link. Those with equal roots are connected to begin with, without a link."""
    order = np.argsort(np.array(sizes), kind="stable")
    n, own = np.array(sizes)[order], Maps([maps[i] for i in order])
    known = None if roots is None else np.array(roots)[order]
    open_, left, out = np.ones(len(order), bool), np.arange(len(order)), []
    while len(left):
        first, left = left[0], left[1:]
        queue, met = [first], set()
        while queue and len(left):
            x = queue.pop()
            near = left[:0]
            if known is not None and known[x] not in met:
                met.add(known[x])
                near = left[known[left] == known[x]]
                open_[near] = False
                left = left[open_[left]]
                queue += near.tolist()
            near = bounded(x, left, n, own)
            if len(near) and sets is not None:
                near = near[linked(sets[order[x]], [sets[order[i]] for i in near])]
            if len(near):
                out += [(ids[order[first]], ids[order[i]]) for i in near]
                queue += near.tolist()
                open_[near] = False
                left = left[open_[left]]
    return out


def _texts(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """h, t: hash and bytes of each text, behind other columns."""
    rows = docs.select(*more, F.col(text).cast("binary").alias("t"))
    return rows.select(*rows.columns[:-1], F.xxhash64("t").alias("h"), "t")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def sets_of(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """d, h, n, c: doc_id, hash of the text, size and class of each row; no class for an empty set. Rows with m hold a
    task's counts of a block k of buckets, copies of a text counted once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, names, kind = {}, Counts(), ["d", "h", "n", "c", "k", "m"], None
        for part in _slices(batches):
            kind, found = part.column(0).type, []
            for h, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if h not in known:
                    own = shingle_set(t)
                    known[h] = len(own), class_id(own) if len(own) else None
                    if len(own):
                        counts.add(own)
                found.append(known[h])
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64()), none, pa.nulls(len(part), pa.binary())], names)
        if kind is not None:
            k, m = zip(*counts.blocks(), strict=True) if counts.size or counts.total.any() else ((), ())
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), kind), none, none, none, pa.array(k, pa.int64()), pa.array(m, pa.binary())], names)

    rows = _texts(docs, text, F.col(doc_id).alias("d"))
    return rows.mapInArrow(read, f"d {rows.schema['d'].dataType.simpleString()}, h long, n long, c long, k long, m binary")


def crowded_buckets(counts: DataFrame) -> np.ndarray:
    """The level of each bucket: 0, or by powers of two of its count where it is crowded. A fixed size, 1 MB."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch.column("k").to_pylist(), batch.column("m").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(m), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(m.tobytes(), 1) for m in sums.values()], pa.binary())], ["k", "m"])

    # in two rounds, so that no task gets a block's counts from all tasks
    some = counts.withColumn("salt", F.spark_partition_id() % 64).repartition("k", "salt").mapInArrow(add, "k long, m binary")
    total = np.zeros((BLOCKS, BUCKETS // BLOCKS), np.int64)
    for row in some.repartition("k").mapInArrow(add, "k long, m binary").toLocalIterator():
        total[row.k] = np.frombuffer(zlib.decompress(row.m), np.int64)
    total, mean = total.ravel(), total.mean()
    least = max(mean + SIGMAS * mean**0.5, 8)
    return np.where(total < least, 0, 1 + np.log2(np.maximum(total, 1))).astype(np.uint8)


def forms_of(docs: DataFrame, text: str, level: np.ndarray) -> DataFrame:
    """c, n, early, late, s: size, prefix and bitmap of each class, a row for each task that has one."""
    order = docs.sparkSession.sparkContext.broadcast(level)

    def lists(own: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _slices(batches):
            out = []
            for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    own = shingle_set(t)
                    if len(own):
                        out.append((class_id(own), len(own), *prefix(own, order.value), bitmap(own)))
            c, n, early, late, bits = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), lists(early), lists(late), pa.array(bits, pa.binary())], ["c", "n", "early", "late", "s"])

    return _texts(docs, text).mapInArrow(read, "c long, n long, early array<long>, late array<long>, s binary")


def gathered(forms: DataFrame) -> DataFrame:
    """g, c, n: the classes of each leader's block, itself included.

    Of the pairs that link, each has a first common shingle; if it is shingle i of x, at most n - i are common, so that y has
    (4 * n - 7 * i) / 3 shingles at most: the reach of x by this shingle.
    """
    reach, first = F.expr("(4 * n - 7 * i) div 3"), F.min(F.struct("n", "c"))
    # the shingles that aren't in a crowded bucket are as rare as a bucket's mean, so that their windows are no hot groups: by
    # rising size, a class beyond the reach of all before it starts anew
    order = Window.partitionBy("k").orderBy("n", "c")
    early = forms.select("c", "n", F.posexplode("early").alias("i", "k")).select("k", "c", "n", reach.alias("reach"))
    far = early.withColumn("far", F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.when(F.col("far").isNull() | (F.col("n") > F.col("far")), F.struct("n", "c"))
    met = far.select("c", "n", F.last(starts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("lead"))
    # the crowded are aggregated before they are sent: in each size band those that reach their own size or more have a
    # leader, and a class meets the leaders of its band and of the one below
    band = F.floor(F.log("n") / math.log(BAND))
    late = forms.select("c", "n", F.size("early").alias("before"), F.posexplode("late").alias("at", "k")).withColumn("i", F.col("before") + F.col("at"))
    late = late.select("k", "c", "n", reach.alias("reach"), band.alias("band"))
    leads = late.where("reach >= n").groupBy("k", "band").agg(first.alias("lead"), F.max("reach").alias("far"))
    late = late.select("k", "c", "n", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).join(leads, ["k", "band"]).where("n <= far")
    pairs = met.unionByName(late.select("c", "n", "lead")).where(F.col("lead.c") != F.col("c"))
    pairs = written(pairs.select(F.col("lead.c").alias("g"), F.col("lead.n").alias("m"), "c", "n").distinct(), "pairs")
    return pairs.select("g", "c", "n").union(pairs.select("g", F.col("g").alias("c"), F.col("m").alias("n")).distinct())


def sets_in(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """c, n, s: the sets of the texts with the hashes h of `wanted`, a row for each task that has one."""
    n = wanted.count()
    rows, bits = _texts(docs, text), None
    if n <= FILTER_MOST:
        width = max(64, 1 << (16 * n - 1).bit_length()) if n else 64
        at = F.pmod("h", F.lit(width))
        words = wanted.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {width}) & 63 AS int)))").alias("b")).toPandas()
        bits = np.zeros(width // 64, np.int64)
        bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
        bits = docs.sparkSession.sparkContext.broadcast(bits)
    else:
        rows = rows.join(wanted, "h", "left_semi").select("h", "t")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _slices(batches):
            if bits is not None:
                at = part.column(0).to_numpy() & (64 * len(bits.value) - 1)
                part = part.filter(pa.array((bits.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            ids, sizes, raw = [], [], []
            for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    own = shingle_set(t)
                    if len(own):
                        ids.append(class_id(own))
                        sizes.append(len(own))
                        raw.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], ["c", "n", "s"])

    return rows.mapInArrow(read, "c long, n long, s binary")


def within(members: DataFrame, forms: DataFrame, exact: bool) -> DataFrame:
    """a, b: a spanning forest of each group g of members c; forms that several tasks sent meet here. With roots, see forest."""
    rooted = "root" in members.columns

    def settle(own: dict[int, tuple]) -> pa.RecordBatch:
        ids = sorted(own)
        n, s = [own[c][0] for c in ids], [own[c][1] for c in ids]
        sets = [np.frombuffer(x, np.uint64) for x in s] if exact else None
        out = forest(ids, n, [bitmap(x) for x in sets] if exact else s, sets, [own[c][2] for c in ids] if rooted else None)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, {}
        for part in _slices(batches, 1024):
            for g, c, *form in zip(*(x.to_pylist() for x in part.columns), strict=True):
                if g != group and len(own) > 1:
                    yield settle(own)
                if g != group:
                    group, own = g, {}
                own[c] = form
        if len(own) > 1:
            yield settle(own)

    rows = members.join(forms.select("c", F.col("n").alias("size"), "s"), "c").select("g", "c", "size", "s", *["root"] * rooted)
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(read, "a long, b long")


def _tiled(members: DataFrame, *by: str) -> DataFrame:
    """members with t, the tile among those with equal `by`."""
    tiles = members.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / TILE_CLASSES), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("_tiles"))
    return members.join(tiles, list(by)).withColumn("t", F.pmod(F.xxhash64("c"), F.col("_tiles"))).drop("_tiles")


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the root of their component."""
    return members.join(components(edges).withColumnRenamed("v", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def connected(members: DataFrame, forms: DataFrame, exact: bool) -> DataFrame:
    """a, b, a stored table: links that connect what all links within the groups g of members (g, c, n) connect."""
    members = written(members, "members")
    large = written(members.groupBy("g").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where((F.col("k") > TILE_CLASSES) | (F.col("n") > TILE_SHINGLES)).select("g"), "large")
    if large.isEmpty():
        out = written(within(members.select("g", "c"), forms, exact), "links")
        drop(members, large)
        return out
    forms = written(forms, "forms")
    small = members.join(large, "g", "left_anti").select(F.xxhash64("g").alias("g"), "c")
    banded = members.join(large, "g", "left_semi").withColumn("band", F.floor(F.log("n") / math.log(BAND)))
    tiles = written(_tiled(banded, "g", "band"), "tiles")
    first = written(within(small.union(tiles.select(F.xxhash64("g", "band", "t"), "c")), forms, exact), "links")
    # one of each component of a tile meets the others
    now = written(_rooted(tiles, first), "rooted")
    some = now.groupBy("g", "band", "t", "root").agg(F.min(F.struct("c", "n")).alias("x"), F.count("*").alias("k")).where("k > 1").select("g", "x.c", "x.n").distinct()
    second = written(within(_tiled(some, "g").select(F.xxhash64("g", "t").alias("g"), "c"), forms, exact), "links")
    drop(now)
    # what is still apart meets in pairs of tiles, but for tiles of one component
    now = written(_rooted(tiles, first.union(second)), "rooted")
    apart = now.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("g")
    now = written(now.join(apart, "g", "left_semi"), "apart")
    big = now.groupBy("g", "root").agg(F.count("*").alias("k")).where(F.col("k") >= OWN_TILES).select("g", "root", F.col("root").alias("own"))
    now = written(_tiled(now.drop("t").join(big, ["g", "root"], "left").withColumn("own", F.coalesce("own", F.lit(0))), "g", "band", "own"), "apart")
    each = now.select("g", "band", "own", "t").distinct()
    a, b = (each.select("g", F.struct("band", "own", "t").alias(s)) for s in "ab")
    # the band of b is that of a or the next; in one band each pair comes once
    pairs = a.join(b, "g").where("b.band - a.band IN (0, 1) AND (a.band < b.band OR a <= b) AND (a.own <> b.own OR a.own = 0)")
    sent = pairs.select("g", F.xxhash64("g", "a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("g", "pair", "x.*")
    third = within(now.join(sent, ["g", "band", "own", "t"]).select(F.col("pair").alias("g"), "c", "root"), forms, exact)
    out = written(first.union(second).union(third), "links")
    drop(members, large, forms, tiles, first, second, now)
    return out


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex that each vertex of an edge is connected with; alternating large-star and small-star steps."""
    now = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).where("v != root").distinct(), "edges")
    while True:
        both = now.union(now.select("root", "v").toDF("v", "root"))
        least = both.groupBy("v").agg(F.min("root").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct()
        floor = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(floor, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).union(floor.select("v", "m").toDF("v", "root")).where("v != root").distinct()
        new = written(small, "edges")
        drop(now)
        # stars have one edge a vertex and no root that has one itself
        if new.select("v").distinct().count() == new.count() and new.join(new.select(F.col("v").alias("root")), "root", "left_semi").isEmpty():
            return new
        now = new


def joined(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    stored = written(sets_of(docs, text, doc_id), "sets")
    sets = stored.where("m is null").select("d", "h", "n", "c")
    classes = sets.where("c is not null").groupBy("c").agg(F.min("d").alias("first"), F.first("n").alias("n"), F.min("h").alias("h"))
    forms = written(forms_of(docs, text, crowded_buckets(stored.where("m is not null").select("k", "m"))), "forms")
    allowed = connected(gathered(forms), forms.select("c", "n", "s").groupBy("c").agg(F.first("n").alias("n"), F.first("s").alias("s")), exact=False)
    groups = components(allowed)
    groups = groups.select(F.col("root").alias("g"), F.col("v").alias("c")).union(groups.select("root", "root").distinct())
    members = written(groups.join(classes, "c").select("g", "c", "n", "h"), "candidates")
    drop(forms, allowed)
    links = connected(members.select("g", "c", "n"), sets_in(docs, text, members.select("h")), exact=True)
    roots = components(links).withColumnRenamed("v", "c")
    drop(links, members)
    of_class = classes.select("c", "first").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    of_root = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(of_root, "root").select("c", "component_id")
    component: Column = F.when(F.col("c").isNull(), F.col("d")).otherwise(F.col("component_id"))
    return sets.join(of_class, "c", "left").select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
