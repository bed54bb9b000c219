"""Substring dedup over a log-structured index of window fingerprints.

A batch of documents becomes sorted immutable runs: for each Arrow batch and each range of hashes one row that packs the
sorted 64-bit window hashes (gaps of 48 bits), and the document of each. Runs of earlier batches are stored the same way.
For each range, stored and new runs are merge-joined into the smallest document of every hash; each new run is then matched
against the merged run, and for windows that start in a smaller document this one is asked for its words. Asks and texts meet
in a second exchange, from which the asked passages go to the places of the documents that may lose them; there words are
compared byte by byte, and those covered by equal windows go. The merged run can be stored as the index for the next batch,
beside its texts; compact() merges stored runs into one.

Merging streams over the runs of a range and holds one entry for each different hash, however many documents share it.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .core import SPACE, U64, cut, drop_existing, fresh, gram_hashes, mix, parts, shared_dir, slices, words

WINDOW = 13
#: Windows that one range of hashes may hold; the number of ranges follows the input.
RANGE_WINDOWS = 1 << 20
#: Windows that a task answers at a time.
SEND_WINDOWS = 1 << 20
RUN_SCHEMA = "bucket int, run binary, fresh boolean"


def pack(hashes: np.ndarray, docs: np.ndarray) -> bytes:
    """A run: sorted hashes as gaps of at most 48 bits (an entry of document -1 carries over larger ones) and documents."""
    ids, ordinal = np.unique(docs, return_inverse=True)
    gaps = np.diff(hashes, prepend=U64(0))
    wide = ids.size > 65535
    id_gaps = np.diff(ids, prepend=np.int64(0))
    narrow = bool(len(id_gaps) and np.abs(id_gaps).max() < 2**31)
    head = np.array([len(hashes), len(ids), wide, narrow], np.int64)
    top = (gaps >> U64(48)).astype(np.uint16)
    at = np.flatnonzero(top)
    return b"".join([
        head.tobytes(), np.int64(len(at)).tobytes(), at.astype(np.int64).tobytes(), top[at].tobytes(),
        id_gaps.astype(np.int32 if narrow else np.int64).tobytes(), ordinal.astype(np.uint32 if wide else np.uint16).tobytes(),
        (gaps & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((gaps >> U64(32)) & U64(0xFFFF)).astype(np.uint16).tobytes(),
    ])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, wide, narrow, k = np.frombuffer(raw, np.int64, 5).tolist()
    at = 40

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    where, top = take(np.int64, k), take(np.uint16, k)
    ids = np.cumsum(take(np.int32 if narrow else np.int64, m).astype(np.int64))
    ordinal = take(np.uint32 if wide else np.uint16, n)
    gaps = take(np.uint32, n).astype(U64)
    gaps |= take(np.uint16, n).astype(U64) << U64(32)
    gaps[where] |= top.astype(U64) << U64(48)
    return np.cumsum(gaps, dtype=U64), ids[ordinal]


def merge(hashes: np.ndarray, docs: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry a hash: its smallest document, and whether several documents have it."""
    order = np.lexsort((docs, hashes))
    h, d, s = hashes[order], docs[order], shared[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return h, d, s
    low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
    return h[at], low, np.logical_or.reduceat(s, at) | (low != high)


class Windows:
    """Window hashes of a batch, with the first word and the row of each window."""

    def __init__(self, w, window: int):
        n = len(w.starts) - window + 1
        ok = np.zeros(max(n, 0), bool)
        if n > 0:
            ok = w.row[:n] == w.row[window - 1 :]
        self.first = np.flatnonzero(ok)
        self.row = w.row[self.first]
        self.hash = gram_hashes(w.hashes, window)[self.first]


def build_runs(docs: DataFrame, text: str, key: str, buckets: int, window: int = WINDOW) -> DataFrame:
    """Run rows of a batch. Rows without a key or with fewer words than a window have none."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(text).alias("text"), F.col(key).cast("long").alias("key"))
    bits = buckets.bit_length() - 1

    def run(batches):
        for b in batches:
            x = Windows(words(b.column("text"), SPACE), window)
            keys = b.column("key").to_numpy(zero_copy_only=False)
            order = np.argsort(x.hash)
            h, d = x.hash[order], keys[x.row[order]]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
            h, d = h[~again], d[~again]
            group = (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            cuts = np.searchsorted(group, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            blobs = [pack(h[cuts[g] : cuts[g + 1]], d[cuts[g] : cuts[g + 1]]) for g in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), pa.array([True] * len(some), pa.bool_())], names=["bucket", "run", "fresh"])

    return rows.mapInArrow(run, RUN_SCHEMA)


class _Merged:
    """The merged run of a range: folds runs in as they come, holding one entry a hash and at most as many not yet folded."""

    def __init__(self):
        self.done = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.wait, self.waiting = [], 0

    def add(self, h, d):
        self.wait.append((h, d, np.zeros(len(h), bool)))
        self.waiting += len(h)
        if self.waiting > max(RANGE_WINDOWS // 2, len(self.done[0])):
            self.fold()

    def fold(self):
        if self.wait:
            self.done = merge(*[np.concatenate(x) for x in zip(self.done, *self.wait, strict=True)])
            self.wait, self.waiting = [], 0
        return self.done


def _ranges(batches):
    """(bucket, iterator of (run, fresh)) of a stream that is ordered by bucket."""

    def flat():
        for b in batches:
            yield from zip(b.column("bucket").to_pylist(), b.column("run"), b.column("fresh").to_pylist(), strict=True)

    for g, rows in itertools.groupby(flat(), key=lambda x: x[0]):
        yield g, ((r.as_py(), f) for _, r, f in rows)


def match_runs(runs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """(place, asks): which windows of a document are wanted where. For each window of a fresh run that also starts in a smaller
    document, the smallest one is asked to send its words to the place of the run's document; asks go by the place of the asked."""

    def run(batches):
        for _, rows in _ranges(batches):
            merged = _Merged()
            with tempfile.TemporaryFile() as spool:  # read once more after merging; unlinked from the start
                sizes = []
                for raw, is_fresh in rows:
                    merged.add(*unpack(raw))
                    if is_fresh:
                        spool.write(raw)
                        sizes.append(len(raw))
                h, low, shared = merged.fold()
                h, low = h[shared], low[shared]
                spool.seek(0)
                out_k, out_p, waiting = [], [], 0
                for size in sizes if len(h) else ():
                    x, d = unpack(spool.read(size))
                    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                    hit = (h[at] == x) & (low[at] < d)
                    asked = low[at[hit]]
                    out_k.append(ask(x[hit], asked, place_of(d[hit], groups), groups))
                    out_p.append(place_of(asked, groups))
                    waiting += int(hit.sum())
                    if waiting > RANGE_WINDOWS:
                        yield _answers(out_k, out_p)
                        out_k, out_p, waiting = [], [], 0
                if waiting:
                    yield _answers(out_k, out_p)

    dealt = runs.repartition(max(buckets, parts(runs.sparkSession)), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "place int, answers binary")


def _answers(keys: list, places: list) -> pa.RecordBatch:
    k, p = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((k, p))
    k, p = k[order], p[order]
    new = (np.diff(p, prepend=-1) != 0) | (np.diff(k, prepend=U64(0)) != 0)  # one ask a window and place
    k, p = k[new], p[new]
    first = np.flatnonzero(np.diff(p, prepend=-1))
    ends = np.append(first[1:], len(p))
    return pa.RecordBatch.from_arrays([pa.array(p[first], pa.int32()), pa.array([k[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["place", "answers"])


def answer_key(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(docs.astype(np.int64).view(U64) + U64(0x632BE59BD9B4E019)))


def place_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (mix(docs.astype(np.int64).view(U64) + U64(7)) % U64(groups)).astype(np.int64)


def ask(h: np.ndarray, docs: np.ndarray, to: np.ndarray, groups: int) -> np.ndarray:
    """An ask in 64 bits: the upper ones of the window's key in its document, below them the place that wants its words.
    Equal upper bits of two windows only send words that nobody needs."""
    bits = U64(max(1, (groups - 1).bit_length()))
    return (answer_key(h, docs) >> bits << bits) | to.astype(U64)


def passages(batch: pa.RecordBatch, text: str, keys: np.ndarray, asks: np.ndarray, groups: int, window: int):
    """Batches of (place, doc, words): the asked windows of the rows of a batch, those that touch as one passage. asks: sorted.
    A batch answers at most SEND_WINDOWS asks at once, or those of one window."""
    w = words(batch.column(text), SPACE)
    x = Windows(w, window)
    bits = U64(max(1, (groups - 1).bit_length()))
    wanted, k = asks >> bits, answer_key(x.hash, keys[x.row]) >> bits
    low = np.searchsorted(wanted, k)
    n = np.searchsorted(wanted, k, side="right") - low
    some = np.flatnonzero(n)
    low, n, first, row = low[some], n[some], x.first[some], x.row[some]
    sums = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] - n[i] + SEND_WINDOWS, side="right")))
        m = n[i:j]
        which = np.repeat(np.arange(i, j), m)
        to = (asks[np.repeat(low[i:j] - np.cumsum(m) + m, m) + np.arange(m.sum())] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        order = np.lexsort((which, to))
        to, f, r = to[order], first[which[order]], row[which[order]]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1]) | (r[1:] != r[:-1]) | (f[1:] > f[:-1] + window)
        at = np.flatnonzero(new)
        begin, end = w.starts[f[at]], w.ends[f[np.append(at[1:], len(to)) - 1] + window - 1]
        size, to, doc = end - begin, to[at], keys[r[at]]
        a = 0
        while a < len(at):  # some MB of words at a time, or one passage
            total = np.cumsum(size[a:])
            c = a + max(1, int(np.searchsorted(total, 8 << 20, side="right")))
            offsets = np.concatenate([[0], total[: c - a]])
            out = w.raw[np.repeat(begin[a:c] - offsets[:-1], size[a:c]) + np.arange(offsets[-1])]
            column = pa.Array.from_buffers(pa.string(), c - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.RecordBatch.from_arrays([pa.array(to[a:c], pa.int32()), pa.array(doc[a:c], pa.int64()), column], names=["place", "doc", "words"])
            a = c
        i = j


def same_words(w, at: np.ndarray, v, to: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows of w that start at words `at` (ascending) have the words, byte by byte, of the windows of v at `to`.
    Windows that follow each other on both sides are compared as one stretch, each word once."""
    if not len(at):
        return np.zeros(0, bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at))) + window - 1
    base = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(base, n)
    a, b = np.repeat(at[head], n) + step, np.repeat(to[head], n) + step
    size = w.ends[a] - w.starts[a]
    wrong = size != v.ends[b] - v.starts[b]
    even = np.flatnonzero(~wrong)
    if len(even):
        size = size[even]
        begin = np.cumsum(size) - size
        inside = np.arange(size.sum())
        unlike = w.raw[np.repeat(w.starts[a[even]] - begin, size) + inside] != v.raw[np.repeat(v.starts[b[even]] - begin, size) + inside]
        wrong[even] = np.logical_or.reduceat(unlike, begin)
    sums = np.concatenate([[0], np.cumsum(wrong)])
    place = np.repeat(base - head, np.diff(np.append(head, len(at)))) + np.arange(len(at))
    return sums[place + window] == sums[place]


class Sent:
    """The windows of the passages that came to a place, by hash, then document."""

    def __init__(self, docs: np.ndarray, texts, window: int):
        self.words = words(texts, SPACE)
        x = Windows(self.words, window)
        doc = docs[x.row]
        order = np.lexsort((doc, x.hash))
        self.hash, self.doc, self.first = x.hash[order], doc[order], x.first[order]

    def covers(self, w, x: Windows, keys: np.ndarray, has_key: np.ndarray, window: int) -> np.ndarray:
        """Whether a smaller document has sent the words of each window."""
        out = np.zeros(len(x.first), bool)
        if not len(self.hash):
            return out
        todo = np.flatnonzero(has_key[x.row])
        at = np.searchsorted(self.hash, x.hash[todo])
        while len(todo):  # a second round only where two windows share a hash
            here = np.minimum(at, len(self.hash) - 1)
            going = (at < len(self.hash)) & (self.hash[here] == x.hash[todo]) & (self.doc[here] < keys[x.row[todo]])
            todo, at = todo[going], at[going]
            out[todo] = same_words(w, x.first[todo], self.words, self.first[at], window)
            todo, at = todo[~out[todo]], at[~out[todo]] + 1
        return out


def remove(batch: pa.RecordBatch, text: str, keys: np.ndarray, has_key: np.ndarray, sent: Sent, window: int) -> dict:
    """n_words, n_removed and kept (words joined by blanks) of the rows of a batch."""
    w = words(batch.column(text), SPACE)
    x = Windows(w, window)
    edge = np.zeros(len(w.starts) + 1, np.int64)
    gone = x.first[sent.covers(w, x, keys, has_key, window)]
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + window, -1)
    stay = np.cumsum(edge)[:-1] == 0
    rows = len(batch)
    size = np.where(stay, w.ends - w.starts, 0)
    last = np.zeros(rows, np.int64)  # blanks: one less than the words that stay
    kept = np.bincount(w.row[stay], minlength=rows)
    total = np.bincount(w.row, weights=size, minlength=rows).astype(np.int64) + np.maximum(kept - 1, last)
    offsets = np.concatenate([[0], np.cumsum(total)])
    out = np.full(offsets[-1], 32, np.uint8)
    s = np.flatnonzero(stay)
    n = size[s]
    nth = np.arange(len(s)) - np.searchsorted(w.row[s], w.row[s])
    before = np.cumsum(n) - n
    base = before[np.searchsorted(w.row[s], w.row[s])] if len(s) else before
    at = offsets[w.row[s]] + nth + before - base
    out[np.repeat(at - before, n) + np.arange(n.sum())] = w.raw[np.repeat(w.starts[s] - before, n) + np.arange(n.sum())]
    column = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return {"n_words": w.counts(), "n_removed": np.bincount(w.row[~stay], minlength=rows), "kept": column}


def bucket_count(docs: DataFrame, text: str) -> int:
    """A power of two: ranges of about RANGE_WINDOWS windows, by the characters of all texts."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return 1 << max(4, int(np.ceil(np.log2(max(1, chars / 6 / RANGE_WINDOWS)))))


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, index: SubstringIndex | None = None) -> DataFrame:
    """docs with n_words, n_removed and kept: the words that no window covers which also starts in a smaller document.

    Smaller documents are those of docs and, if given, of the index. A null or short text keeps all of its words; a row
    with a null key neither loses words nor takes any from others; rows with equal keys are one document and take nothing
    from each other. kept joins words by one blank. Columns with added names are replaced. Empty tables give empty results.
    """
    docs = drop_existing(docs, ["n_words", "n_removed", "kept"])
    buckets = index.buckets if index else bucket_count(docs, text)
    groups = max(buckets, parts(docs.sparkSession))
    runs = build_runs(docs, text, key, buckets, window)
    if index:
        runs = runs.unionByName(index.runs())
    asks = match_runs(runs, buckets, groups)
    place, got, kind = fresh(docs, "place", "answers", "kind")
    names, schema = docs.columns, docs.schema

    def locate(batches):
        for b in batches:
            k = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(place_of(k, groups), pa.int32())], names=[*b.schema.names[:-1], place])

    rows = docs.withColumn(kind, F.lit(1))
    if index:  # stored documents send words and get no row
        old = index.texts().select(F.col("key").cast(schema[key].dataType).alias(key), F.col("text").alias(text), F.lit(2).alias(kind))
        rows = rows.unionByName(old, allowMissingColumns=True)
    number = F.coalesce(F.col(key).cast("long"), F.lit(0))
    located = rows.withColumn(place, number).mapInArrow(locate, StructType([*rows.schema.fields, StructField(place, IntegerType())]))
    both = located.withColumn(got, F.lit(None).cast("binary")).unionByName(asks.select(F.col("place").alias(place), F.col("answers").alias(got), F.lit(0).alias(kind)), allowMissingColumns=True)
    dealt = both.repartition(groups, place)

    def send(batches):
        now, have, sorted_ = None, [], None
        for b in batches:
            p, k = b.column(place).to_numpy(zero_copy_only=False), b.column(kind).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(k, prepend=-1) != 0)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(p)], strict=True):
                if p[i] != now:
                    now, have, sorted_ = p[i], [], None
                if k[i] == 0:
                    have += [np.frombuffer(x.as_py(), U64) for x in b.column(got).slice(i, j - i)]
                    continue
                if sorted_ is None:
                    sorted_ = np.unique(np.concatenate(have)) if have else np.zeros(0, U64)
                    have = []
                if len(sorted_):
                    part = b.slice(i, j - i)
                    for s in slices(part.filter(part.column(key).is_valid()), text, 8 << 20):
                        if s.num_rows:
                            yield from passages(s, text, s.column(key).cast(pa.int64()).to_numpy(), sorted_, groups, window)

    sent = dealt.sortWithinPartitions(place, kind).mapInArrow(send, "place int, doc long, words string").repartition(groups, "place")
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]

    def finish(mine, came):
        have = Sent(came.column("doc").to_numpy(), came.column("words"), window)
        out = []
        mine = mine.filter(pa.compute.equal(mine.column(kind), 1)).select(names)
        for b in mine.combine_chunks().to_batches() if mine.num_rows else ():
            for s in slices(b, text, 8 << 20):
                ids = s.column(key).cast(pa.int64())
                r = remove(s, text, ids.fill_null(0).to_numpy(zero_copy_only=False), s.column(key).is_valid().to_numpy(zero_copy_only=False), have, window)
                out.append(pa.RecordBatch.from_arrays([*s.columns, pa.array(r["n_words"]), pa.array(r["n_removed"]), r["kept"]], names=[*names, "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], pa.schema([*mine.schema, ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return dealt.groupBy(place).cogroup(sent.groupBy("place")).applyInArrow(finish, StructType([*schema.fields, *added]))


class SubstringIndex:
    """Stored runs in a folder that all machines share; each add() writes one more, compact() merges all of them into one.

    An index is its folder: naming an existing one opens it again, with its own buckets and window. A run counts once it is written
    whole. Rows without a key or with fewer words than a window add nothing; an empty batch adds an empty run."""

    def __init__(self, spark, path: str | None = None, buckets: int = 16, window: int = WINDOW):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        if not self._there("settings"):
            spark.createDataFrame([(buckets, window)], "buckets int, window int").coalesce(1).write.parquet(f"{self.path}/settings")
        self.buckets, self.window = spark.read.parquet(f"{self.path}/settings").first()

    def _there(self, name: str) -> bool:
        return self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))

    def _files(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def stored(self) -> list[str]:
        names = [x.getPath().getName() for x in self._files().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))]
        return sorted(n for n in names if n.startswith("run-") and self._there(n))

    def runs(self) -> DataFrame:
        out = self.spark.createDataFrame([], RUN_SCHEMA)
        for name in self.stored():
            out = out.unionByName(self.spark.read.schema(out.schema).parquet(f"{self.path}/{name}"))
        return out.withColumn("fresh", F.lit(False))

    def texts(self) -> DataFrame:
        """(key, text) of all documents added: their words are compared with those of later ones."""
        names = [x.getPath().getName() for x in self._files().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))]
        out = self.spark.createDataFrame([], "key long, text string")
        have = [n for n in names if n.startswith("text-") and self._there(n)]
        if self.stored() and not have:
            raise ValueError(f"{self.path} holds runs without texts; add its documents again")
        for name in have:
            out = out.unionByName(self.spark.read.schema(out.schema).parquet(f"{self.path}/{name}"))
        return out

    def _write(self, runs: DataFrame) -> None:
        self._merged(runs).write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")

    def add(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
        kept = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        kept.write.parquet(f"{self.path}/text-{uuid.uuid4().hex}")
        self._write(build_runs(docs, text, key, self.buckets, self.window))

    def compact(self) -> None:
        """One run in place of all; a crash in between leaves runs that say the same twice."""
        before = self.stored()
        if len(before) > 1:
            self._write(self.runs())
            for name in before:
                self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _merged(self, runs: DataFrame) -> DataFrame:
        def run(batches):
            for g, rows in _ranges(batches):
                merged = _Merged()
                for raw, _ in rows:
                    merged.add(*unpack(raw))
                h, low, _ = merged.fold()
                for i in range(0, len(h), RANGE_WINDOWS):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pack(h[i : i + RANGE_WINDOWS], low[i : i + RANGE_WINDOWS])], pa.binary()), pa.array([False])], names=["bucket", "run", "fresh"])

        return runs.repartition(max(self.buckets, parts(self.spark)), "bucket").sortWithinPartitions("bucket").mapInArrow(run, RUN_SCHEMA)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (
            SELECT doc_id, i, hash(list_slice(w, i, i + 12)) AS g, list_slice(w, i, i + 12) AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        low AS (SELECT g, words, min(doc_id) AS low FROM win GROUP BY g, words HAVING min(doc_id) < max(doc_id)),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
            FROM win JOIN low USING (g, words) WHERE low < doc_id),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (
            SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n
            FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
}
