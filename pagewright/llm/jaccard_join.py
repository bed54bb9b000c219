"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of five-word shingles; two link when 100 * |A & B| >= 80 * |A | B|. Shingles are hashed into groups,
and a set's counts by group are a point. For two sets the sum of the smaller counts bounds the overlap, and for two
boxes of points the sum of the smaller upper corners does, so the R-tree over the points (CountTree) finds all pairs that can link;
surviving pairs are verified on the sets. Pairs inside a component that is already known are skipped: the result is
connected components, so a group of n copies costs about n checks, not n squared.

One tree over all documents would not fit a task, so trees are built over blocks. Documents with equal sets are one class from the
start. Two classes that link share at least one of their first n - ceil(0.8 n) + 1 shingles in any fixed order; the order used
puts shingles that a fixed-size count sketch of the corpus finds frequent last, so shared boilerplate makes no large blocks. Blocks are
the classes that share such a shingle:

1. profile: class, size and point of every document, and the sketch (one pass over the texts);
2. blocks: classes by shared shingle, equal blocks once (second pass); trees over the points of each block give edges that may link. A block
   is joined in parts of bounded size first; of each component in a part, only the boxes around its points meet the other parts;
3. components of these edges, cut into chunks of bounded size; the sets of their classes (third pass) are joined exactly by a tree in
   each chunk, then the representatives of the chunks, then, for components that are still not one, chunk by chunk.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U64, components, cut, discard, gram_hashes, in_arrow, mix, parts, salted_lookup, slices, words

SHINGLE = 5
LINK = (80, 100)
#: (greatest set size, groups): larger sets need more groups for counts to tell them apart. A tree takes sizes from one
#: bound to LINK times the next, so that two sets that can link always meet in one tree.
GROUPS = [(1024, 128), (8192, 512), (2**62, 2048)]
LEAF = 16
CELLS = 1 << 20  # of the sketch: one byte each is broadcast
SKETCH_BLOCKS = 64
#: A block of more classes is linked as a whole before verification; a chunk holds about this many shingles.
LARGEST_BLOCK = 50_000
BLOCK_PART = 512  # classes of a block that one tree holds
CHUNK_SHINGLES = 2_000_000
BUCKET_ENTRIES = 250_000  # prefix entries that one task groups
BLOOM_BITS = 1 << 26  # 8 MB
PIECE = 4 << 20  # bytes of text that a worker hashes at a time


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    w = words(col, lower=True)
    grams = gram_hashes(w.hashes, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(gram_hashes(w.hashes[a:b], b - a, 0x2C1B3C6D + b - a) if b > a else np.zeros(0, U64))
    return out


def groups_of(n: int) -> int:
    return next(g for most, g in GROUPS if n <= most)


def point(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((mix(s) % U64(groups)).astype(np.int64), minlength=groups)


def pack_point(s: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for 255 or more."""
    return np.minimum(point(s, groups_of(len(s))), 255).astype(np.uint8).tobytes()


def unpack_point(raw: bytes, n: int, groups: int) -> np.ndarray:
    """Upper bounds of the counts, folded to fewer groups; n: the set's size, or the greatest in a box."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    x[x == 255] = n
    return x.reshape(-1, groups).sum(0)


def size_ranges(sizes: np.ndarray):
    """(number, groups, places of the sets) of the range of sizes of each tree."""
    least = 0
    for number, (most, groups) in enumerate(GROUPS):
        yield number, groups, np.flatnonzero((sizes > least) & (sizes * LINK[0] <= most * LINK[1]))
        least = most


def join_components(sizes: np.ndarray, point_at, check, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> np.ndarray:
    """Component numbers (the first member's) of sets of any sizes: one tree for each range of sizes.

    point_at(i, groups): the count vector of set i. check(a, b): whether two sets link."""
    k = len(sizes)
    root = list(range(k))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(at, heads):
        for i, h in zip(at, heads, strict=True):
            a, b = find(i), find(h)
            root[max(a, b)] = min(a, b)

    if labels is not None:
        unite(range(k), label_heads(labels))
    for _, groups, at in size_ranges(sizes):
        if len(at) > 1:
            tree = CountTree(np.stack([point_at(int(i), groups) for i in at]), sizes[at])
            now = np.array([find(int(i)) for i in at])
            found = tree.join(lambda a, b, at=at: check(int(at[a]), int(at[b])), now, None if sides is None else sides[at])
            unite(at.tolist(), [int(at[h]) for h in label_heads(found)])
    return np.array([find(i) for i in range(k)])


def class_of(s: np.ndarray) -> int:
    """A 63-bit number that stands for a set; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.array([mix(s).sum(dtype=U64) + U64(len(s)) * U64(0x9E3779B97F4A7C15)], U64)
    return int(mix(x)[0] >> U64(1)) or 1


def links(n_a, n_b, common):
    return LINK[1] * common >= LINK[0] * (n_a + n_b - common)


class CountTree:
    """R-tree over count vectors, packed in order of size. join() finds the components of a link predicate.

    With tops, its entries are boxes: points are their upper corners, sizes and tops the least and greatest size in each."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, tops: np.ndarray | None = None):
        self.order = np.lexsort((points[:, 0], sizes))
        self.p, self.n = points[self.order].astype(np.int32), sizes[self.order].astype(np.int64)
        self.top = self.n if tops is None else tops[self.order].astype(np.int64)
        self.levels = []  # of boxes: (upper corners, least size, greatest size), leaves first
        hi, lo_n, hi_n = self.p, self.n, self.top
        while True:
            at = np.arange(0, len(hi), LEAF)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, at), np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
            self.levels.append((hi, lo_n, hi_n))
            if len(hi) <= LEAF:
                break

    @staticmethod
    def _may(hi_a, hi_b, lo_a, lo_b, up_a, up_b):
        """Whether some pair of the two boxes can link, by sizes and by the sum of the smaller counts."""
        ok = (LINK[1] * up_a >= LINK[0] * lo_b) & (LINK[1] * up_b >= LINK[0] * lo_a)
        at = np.flatnonzero(ok)
        for s in range(0, len(at), 4096):
            i = at[s : s + 4096]
            bound = np.minimum(hi_a[i], hi_b[i]).sum(1)
            ok[i] = (LINK[0] + LINK[1]) * bound >= LINK[0] * (lo_a[i] + lo_b[i])
        return ok

    def join(self, check, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> np.ndarray:
        """Component numbers of the points in their given order. check(a, b): whether two points link, by given number.

        labels: components known before. sides: only points of different sides are compared."""
        k = len(self.n)
        start = np.arange(k) if labels is None else np.unique(labels, return_inverse=True)[1]
        root = list(range(k))
        label = start[self.order]
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            root[i] = first.setdefault(x, i)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        side = None if sides is None else sides[self.order]
        label = np.array([find(i) for i in range(k)])
        top = len(self.levels) - 1
        m = len(self.levels[top][0])
        i, j = np.triu_indices(m)
        stack = [(top, i, j)]
        spread = self._spread(label)
        while stack:
            level, i, j = stack.pop()
            lo, hi = spread[level]
            one = (lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j])
            i, j = i[~one], j[~one]
            if not len(i):
                continue
            step = 4096 if level else 64
            if len(i) > step:
                stack.append((level, i[step:], j[step:]))
                i, j = i[:step], j[:step]
            b, least, most = self.levels[level]
            ok = self._may(b[i], b[j], least[i], least[j], most[i], most[j])
            i, j = i[ok], j[ok]
            size = k if level == 0 else len(self.levels[level - 1][0])
            a = (i[:, None, None] * LEAF + np.arange(LEAF)[None, :, None]).repeat(LEAF, 2).ravel()
            c = (j[:, None, None] * LEAF + np.arange(LEAF)[None, None, :]).repeat(LEAF, 1).ravel()
            ok = (a < size) & (c < size) & ((a < c) if level == 0 else (a <= c))
            a, c = a[ok], c[ok]
            if level:
                near = np.argsort(c - a, kind="stable")
                stack.append((level - 1, a[near], c[near]))
                continue
            ok = label[a] != label[c]
            if side is not None:
                ok &= side[a] != side[c]
            a, c = a[ok], c[ok]
            ok = self._may(self.p[a], self.p[c], self.n[a], self.n[c], self.top[a], self.top[c]) if len(a) else ok[:0]
            changed = False
            for x, y in zip(a[ok].tolist(), c[ok].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry and check(int(self.order[x]), int(self.order[y])):
                    root[max(rx, ry)] = min(rx, ry)
                    changed = True
            if changed:
                label = np.array([find(i) for i in range(k)])
                spread = self._spread(label)
        out = np.empty(k, np.int64)
        out[self.order] = label
        return out

    def _spread(self, label):
        """Least and greatest component in each box, by level."""
        out, lo, hi = [], label, label
        for _ in self.levels:
            at = np.arange(0, len(lo), LEAF)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            out.append((lo, hi))
        return out


def profile(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (id, class, n, point) for every document, and rows (block, cells) of the sketch; the others are null."""

    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for b in (x for whole in batches for x in slices(whole, "text", PIECE)):
            sets = shingle_sets(b.column("text"))
            n = np.array([len(s) for s in sets], np.int64)
            points = [pack_point(s) for s in sets]
            yield _batch(id=b.column("id"), cls=pa.array([class_of(s) for s in sets], pa.int64()), n=pa.array(n), point=pa.array(points, pa.binary()), block=pa.nulls(len(n), pa.int32()), cells=pa.nulls(len(n), pa.binary()))
            for s in sets:
                np.add.at(cells, (s >> U64(44)).astype(np.int64), 1)
        each = CELLS // SKETCH_BLOCKS
        blocks = [cells[i * each : (i + 1) * each].astype("<u4").tobytes() for i in range(SKETCH_BLOCKS)]
        none = pa.nulls(SKETCH_BLOCKS, pa.int64())
        yield _batch(id=none, cls=none, n=none, point=pa.nulls(SKETCH_BLOCKS, pa.binary()), block=pa.array(range(SKETCH_BLOCKS), pa.int32()), cells=pa.array(blocks, pa.binary()))

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return cut(in_arrow(rows, run, "id long, cls long, n long, point binary, block int, cells binary"), "profile")


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sketch_levels(table: DataFrame) -> np.ndarray:
    """How many times the mean a cell's count is, as a power of two, at least 0: one byte a cell."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(raw.as_py(), "<u4").astype(np.int64)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield _batch(block=pa.array(list(sums), pa.int32()), cells=pa.array([x.tobytes() for x in sums.values()], pa.binary()))

    rows = table.where(F.col("block").isNotNull()).select("block", "cells")
    cells = np.zeros((SKETCH_BLOCKS, CELLS // SKETCH_BLOCKS))
    for r in in_arrow(rows.repartition(SKETCH_BLOCKS, "block"), add, "block int, cells binary").toLocalIterator():
        cells[r["block"]] = np.frombuffer(r["cells"], np.int64)
    cells = cells.ravel()
    return np.clip(np.log2(np.maximum(cells, 1) / max(1.0, cells.mean())), 0, 40).astype(np.uint8)


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles, rare ones first, as numbers that order them."""
    key = (levels[(s >> U64(44)).astype(np.int64)].astype(U64) << U64(58)) | (s >> U64(6))
    n = len(s)
    return np.sort(key)[: n - (LINK[0] * n + LINK[1] - 1) // LINK[1] + 1] if n else key


def blocks(docs: DataFrame, text: str, levels: np.ndarray, buckets: int) -> DataFrame:
    """(block, part, parts, cls) of the blocks of several classes, equal ones once in a bucket, each in parts of BLOCK_PART classes;
    (cls, other) edges, the rest null, for those over LARGEST_BLOCK."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # CELLS bytes

    def emit(batches):
        for b in (x for whole in batches for x in slices(whole, "text", PIECE)):
            seen, keys, owner = set(), [], []
            for s in shingle_sets(b.column("text")):
                c = class_of(s)
                if c and c not in seen:
                    seen.add(c)
                    keys.append(prefix(s, shared.value))
                    owner.append(np.full(len(keys[-1]), c, np.int64))
            if not keys:
                continue
            k, o = np.concatenate(keys), np.concatenate(owner)
            bucket = (mix(k) % U64(buckets)).astype(np.int64)
            order = np.lexsort((k, bucket))
            k, o, bucket = k[order], o[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield _batch(bucket=pa.array(some, pa.int32()), run=pa.array([_pack(k[cuts[g] : cuts[g + 1]], o[cuts[g] : cuts[g + 1]]) for g in some.tolist()], pa.binary()))

    def group(batches):
        for _, rows in itertools.groupby(((g, r) for b in batches for g, r in zip(b.column(0).to_pylist(), b.column(1), strict=True)), key=lambda x: x[0]):
            k, o = (np.concatenate(x) for x in zip(*(_unpack(r.as_py()) for _, r in rows), strict=True))
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            again = np.zeros(len(k), bool)
            again[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
            k, o = k[~again], o[~again]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(first, len(k)))
            for large in np.flatnonzero(size > LARGEST_BLOCK).tolist():
                x = o[first[large] : first[large] + size[large]]
                none = pa.nulls(len(x), pa.int32())
                yield _batch(block=pa.nulls(len(x), pa.int64()), part=none, parts=none, cls=pa.array(x), other=pa.array(np.full(len(x), x[0])))
            keep = (size > 1) & (size <= LARGEST_BLOCK)
            name = np.add.reduceat(mix(o.view(U64)), first) if len(first) else k
            _, once = np.unique(name[keep], return_index=True)
            at = np.flatnonzero(keep)[once]
            n = size[at]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # in its block; equal blocks have equal places
            rows_at = np.repeat(first[at], n) + place
            if len(rows_at):
                part, many = (place // BLOCK_PART).astype(np.int32), np.repeat(-(-n // BLOCK_PART), n).astype(np.int32)
                yield _batch(block=pa.array(np.repeat((name[at] >> U64(1)).astype(np.int64), n)), part=pa.array(part), parts=pa.array(many), cls=pa.array(o[rows_at]), other=pa.nulls(len(rows_at), pa.int64()))

    runs = in_arrow(docs.select(F.col(text).alias("text")), emit, "bucket int, run binary")
    dealt = runs.repartition(max(buckets, parts(docs.sparkSession)), "bucket").sortWithinPartitions("bucket")
    return cut(in_arrow(dealt, group, "block long, part int, parts int, cls long, other long"), "blocks")


def _pack(k: np.ndarray, o: np.ndarray) -> bytes:
    ids, ordinal = np.unique(o, return_inverse=True)
    wide = len(ids) > 65535
    return np.array([len(k), len(ids), wide], np.int64).tobytes() + k.tobytes() + ids.tobytes() + ordinal.astype(np.uint32 if wide else np.uint16).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, wide = np.frombuffer(raw, np.int64, 3).tolist()
    k = np.frombuffer(raw, U64, n, 24)
    ids = np.frombuffer(raw, np.int64, m, 24 + 8 * n)
    return k, ids[np.frombuffer(raw, np.uint32 if wide else np.uint16, n, 24 + 8 * n + 8 * m)]


def _streams(batches, keys: list[str]):
    """(key, rows of it as lists by column) of a stream that is ordered by the keys."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in keys), *(b.column(c).to_pylist() for c in b.schema.names if c not in keys), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[: len(keys)]):
        yield key, [list(c) for c in zip(*(r[len(keys) :] for r in group), strict=True)]


def possible_edges(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), in the shared folder: edges whose components hold every pair of a block whose points can link.

    Each part of a block is joined by itself. Where a block has several, the components of a part go on as boxes, one for each
    range of sizes; boxes of different parts that can hold a linking pair join their components."""
    box = "block long, range int, part int, head long, least long, most long, corner binary"

    def join_parts(batches):
        for (block, part, many), (cls, n, points) in _streams(batches, ["block", "part", "parts"]):
            sizes = np.array(n)
            heads = np.array(label_heads(join_components(sizes, lambda i, g, n=n, points=points: unpack_point(points[i], n[i], g), lambda a, b: True)))
            a = np.array(cls)
            b = a[heads]
            if (a != b).any():
                yield _with_nulls(box, a=a[a != b], b=b[a != b])
            for number, groups, at in size_ranges(sizes) if many > 1 else ():
                if len(at):
                    at = at[np.argsort(heads[at], kind="stable")]
                    first = np.flatnonzero(np.append(True, np.diff(heads[at]) != 0))
                    high = np.maximum.reduceat(np.stack([unpack_point(points[i], n[i], groups) for i in at.tolist()]), first)
                    corner = [x.tobytes() for x in np.minimum(high, 255).astype(np.uint8)]
                    same = np.full(len(first), 1)
                    yield _with_nulls(box, block=same * block, range=same * number, part=same * part, head=b[at[first]], least=np.minimum.reduceat(sizes[at], first), most=np.maximum.reduceat(sizes[at], first), corner=corner)

    def join_boxes(batches):
        for (_, number), (part, head, least, most, corner) in _streams(batches, ["block", "range"]):
            high = np.stack([unpack_point(x, top, GROUPS[number][1]) for x, top in zip(corner, most, strict=True)])
            label = CountTree(high, np.array(least), np.array(most)).join(lambda a, b: True, sides=np.array(part))
            a = np.array(head)
            b = a[label_heads(label)]
            if (a != b).any():
                yield _batch(a=pa.array(a[a != b]), b=pa.array(b[a != b]))

    places = members.where(F.col("block").isNotNull()).select("block", "part", "parts", "cls").distinct()
    rows = salted_lookup(places, classes, ["cls"], F.col("block"), how="inner")
    n = parts(members.sparkSession)
    dealt = rows.select("block", "part", "parts", "cls", "n", "point").repartition(n, "block", "part").sortWithinPartitions("block", "part", "parts")
    found = cut(in_arrow(dealt, join_parts, f"a long, b long, {box}"), "parts")
    boxes = found.where(F.col("block").isNotNull()).select("block", "range", "part", "head", "least", "most", "corner")
    between = in_arrow(boxes.repartition(n, "block", "range").sortWithinPartitions("block", "range"), join_boxes, "a long, b long")
    edges = cut(found.where(F.col("a").isNotNull()).select("a", "b").unionByName(between), "may")
    discard(found)
    return edges


def _with_nulls(box: str, **columns) -> pa.RecordBatch:
    """A batch with the columns a, b and those of box; the ones not given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    fields = [f.split() for f in ("a long, b long, " + box).split(", ")]
    return _batch(**{name: pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(size, kinds[kind]) for name, kind in fields})


def label_heads(label) -> list[int]:
    """For each point the first point of its component."""
    first: dict[int, int] = {}
    return [first.setdefault(x, i) for i, x in enumerate(label.tolist())]


def exact_edges(rows: DataFrame, keys: list[str], tiles: bool = False) -> DataFrame:
    """(a, b): links that span the components of each group of rows (cls, known, side, members): sets are compared exactly."""

    def run(batches):
        for _, (cls, known, side, raw) in _streams(batches, keys):
            sets: dict[int, np.ndarray] = {}
            order = []
            for i, c in enumerate(cls):
                if c not in sets:
                    sets[c] = np.frombuffer(raw[i], U64)
                    order.append(i)
            c = [cls[i] for i in order]
            s = [sets[x] for x in c]
            if len(s) < 2:
                continue

            def check(a, b, s=s):
                x, y = (s[a], s[b]) if len(s[a]) < len(s[b]) else (s[b], s[a])
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                return bool(links(len(x), len(y), int((y[at] == x).sum())))

            label = join_components(np.array([len(x) for x in s]), lambda i, g, s=s: point(s[i], g), check, np.array([known[i] for i in order]), np.array([side[i] for i in order]) if tiles else None)
            out = [(x, c[h]) for x, h in zip(c, label_heads(label), strict=True) if x != c[h]]
            if out:
                a, b = zip(*out, strict=True)
                yield _batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    n = parts(rows.sparkSession)
    dealt = rows.select(*keys, "cls", "known", "side", "members").repartition(n, *keys).sortWithinPartitions(*keys)
    return in_arrow(dealt, run, "a long, b long")


def sets_of(docs: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """wanted (id, cls, ...) with members, the sets of the classes. A Bloom filter of BLOOM_BITS keeps other texts out of the exchange."""
    spot = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    marked = wanted.select(spot.alias("p")).select(F.bitmap_bucket_number(F.col("p") + 1).alias("k"), F.bitmap_bit_position(F.col("p") + 1).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("m"))
    for r in marked.toLocalIterator():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            p = b.column("p").to_numpy(zero_copy_only=False)
            at = np.flatnonzero((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
            for part in slices(b.take(pa.array(at)), "text", PIECE) if len(at) else ():
                sets = shingle_sets(part.column("text"))
                yield _batch(id=part.column("id"), cls=pa.array([class_of(s) for s in sets], pa.int64()), members=pa.array([s.tobytes() for s in sets], pa.binary()))

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("p", spot)
    return wanted.join(in_arrow(rows, run, "id long, cls long, members binary"), ["id", "cls"])


def linked_classes(docs: DataFrame, text: str, key: str, table: DataFrame) -> DataFrame:
    """(cls, root) of the classes that link with others."""
    real = table.where(F.col("block").isNull() & F.col("id").isNotNull() & (F.col("n") > 0))
    classes = real.groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("point").alias("point"))
    total = table.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(2, int(total // 5 // BUCKET_ENTRIES).bit_length())
    members = blocks(docs.where(F.col(key).isNotNull()), text, sketch_levels(table), buckets)
    close = possible_edges(members, classes)
    may = close.unionByName(members.where(F.col("other").isNotNull()).select(F.col("cls").alias("a"), F.col("other").alias("b")))
    coarse = components(may)
    discard(members, close)
    wanted = salted_lookup(coarse.withColumnsRenamed({"node": "cls", "root": "comp"}), classes.select("cls", "id", "n"), ["cls"], F.col("cls"), how="inner")
    weight = wanted.groupBy("comp").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks"))
    wanted = salted_lookup(wanted, weight, ["comp"], F.col("cls")).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    wanted = cut(wanted, "wanted")  # read twice; its joins would be planned and broadcast each time
    rows = cut(sets_of(docs, text, key, wanted).withColumn("side", F.col("chunk")), "sets")
    discard(wanted)
    edges = cut(exact_edges(rows.withColumn("known", F.col("cls")), ["comp", "chunk"]), "links")
    large = rows.where("chunks > 1")
    if large.isEmpty():
        discard(rows)
        return _done(edges)
    for turn in itertools.count():  # representatives of the components found so far, over fewer and fewer chunks
        found = components(edges)
        labelled = salted_lookup(large, found.withColumnsRenamed({"node": "cls", "root": "label"}), ["cls"], F.col("cls")).withColumn("label", F.coalesce("label", "cls"))
        heads = labelled.where("cls = label")
        size = heads.groupBy("comp").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("heads"))
        again = salted_lookup(heads, size.where("heads > 1"), ["comp"], F.col("cls"), how="inner")
        again = again.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(turn)), F.ceil(F.col("size") / CHUNK_SHINGLES)).cast("int"))
        more = cut(exact_edges(again.withColumn("known", F.col("cls")), ["comp", "part"]), "links")
        if more.isEmpty():
            discard(more)
            break
        before, edges = edges, cut(edges.unionByName(more), "links")
        discard(before, more)
    open_ = salted_lookup(labelled, size.where("heads > 1").select("comp", "heads"), ["comp"], F.col("cls"), how="inner").withColumn("known", F.col("label"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tiled = open_.select("*", other).where("other <> chunk").withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    last = cut(exact_edges(tiled, ["comp", "lo", "hi"], tiles=True), "links")
    discard(rows)
    return _done(edges, last)


def _done(*edges: DataFrame) -> DataFrame:
    found = components(functools.reduce(DataFrame.unionByName, edges))
    discard(*edges)
    return found


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: the key, n_shingles (size of its set) and component_id (the smallest key that links reach,
    its own included).

    A null or empty text, or one of white space, has an empty set and links with nothing. A row with a null key links with nothing
    either and has a null component_id. Rows with equal sets link, repeated rows too. Keys are integers. Other columns of docs are
    not read. An empty table gives an empty result.
    """
    table = profile(docs, text, key)
    found = linked_classes(docs, text, key, table)
    real = table.where(F.col("block").isNull()).select("id", "cls", "n")
    by = F.coalesce("id", F.lit(0))
    labelled = salted_lookup(real, found.withColumnsRenamed({"node": "cls", "root": "label"}), ["cls"], by).withColumn("label", F.coalesce("label", "cls"))
    low = labelled.where("n > 0 and id is not null").groupBy("label").agg(F.min("id").alias("low"))
    each = salted_lookup(labelled, low, ["label"], by)
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("low")).otherwise(F.col("id"))
    return each.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def stage_jaccard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id; every document with a null doc_id, which is linked with nothing.

    Null and empty texts are linked with nothing and stay; rows that repeat the smallest doc_id stay with it; an empty table
    stays empty; other columns are passed on as they are."""
    first = jaccard_join(docs).where("doc_id = component_id").select("doc_id")
    kept = docs.join(first.distinct(), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op3_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc, e.y FROM r JOIN e ON r.root = e.x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE doc = d.doc_id) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""
}
