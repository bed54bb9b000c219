"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The symbols are words, the blocks are pairs of neighbouring words. Patterns are the benchmark's windows of WINDOW
words, and items of fewer words as a whole. Patterns of one length share a shift table, indexed by a hash of the block
that ends at the current place: a block that no pattern holds lets the search skip WINDOW - 1 words, any other as many
as its last place in a pattern allows. At shift zero the block's hash picks the patterns that end in it, and the words
themselves are compared, first by hash, then byte by byte. Many stretches of text move in step in numpy.

Compiled patterns are places in one buffer of the benchmark's words: with hashes and tables some ten times the text. The
benchmark is compiled in blocks of about BLOCK_BYTES of text (an item is not split). Each block is one pass over the documents that
adds to the row's own columns, so nothing shuffles, and a benchmark of any size costs passes rather than memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import NOT_ALNUM, U64, Words, cut, drop_existing, fresh, map_batches, shelter, words

WINDOW = 8
BLOCK_BYTES = 4 << 20
TABLE = 1 << 18
STRETCH = 512
_PAIR = U64(0x9FB21C651E98DF25)


def _blocks(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of `size` words that ends at each place."""
    return h[at] if size == 1 else (h[at - 1] * _PAIR + h[at])


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b are the same bytes, for arrays of places."""
    n = a.ends[i] - a.starts[i]
    out = n == b.ends[j] - b.starts[j]
    at = np.flatnonzero(out)
    if len(at):
        n = n[at]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum())
        differ = a.raw[np.repeat(a.starts[i[at]] - begin, n) + step] != b.raw[np.repeat(b.starts[j[at]] - begin, n) + step]
        out[at] = ~np.logical_or.reduceat(differ, begin)
    return out


class Patterns:
    """Compiled patterns of one length: shift table, suffix buckets, the first word of each pattern in w, and its items."""

    def __init__(self, length: int, w: Words, first: np.ndarray, cuts: np.ndarray, items: np.ndarray):
        self.length, self.w = length, w
        self.block = min(2, length)
        keys = _blocks(w.hashes, first + length - 1, self.block)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.number = keys[order], first[order], order
        self.cuts, self.items = cuts, items  # items[cuts[p] : cuts[p + 1]]: numbers of the items of pattern p
        self.shift = np.full(TABLE, length - self.block + 1, np.uint8)
        for j in range(self.block - 1, length):  # blocks further right allow smaller shifts
            b = _blocks(w.hashes, first + j, self.block)
            np.minimum.at(self.shift, (b % U64(TABLE)).astype(np.int64), np.uint8(length - 1 - j))

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last words of the occurrences, pattern of each), within rows."""
        n, h = self.length, w.hashes
        starts, stops = w.first[:-1] + n - 1, w.first[1:]
        rows = np.flatnonzero(starts < stops)
        cuts = -(-(stops[rows] - starts[rows]) // STRETCH)
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(starts[rows], cuts) + k * STRETCH
        end = np.minimum(at + STRETCH, np.repeat(stops[rows], cuts))
        found = []
        while len(at):
            key = _blocks(h, at, self.block)
            step = self.shift[(key % U64(TABLE)).astype(np.int64)]
            hit = step == 0
            if hit.any():
                found.append(np.stack([at[hit].astype(U64), key[hit]]))
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, key = np.concatenate(found, axis=1)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        many = hi - lo
        place = np.repeat(place.astype(np.int64), many)
        which = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        for test in (lambda i, j: h[i] == self.w.hashes[j], lambda i, j: same_words(w, i, self.w, j)):
            for j in range(n):
                same = test(place - (n - 1 - j), self.first[which] + j)
                place, which = place[same], which[same]
        return place, self.number[which]


def compile_patterns(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[list[Patterns], list[str]]:
    """(patterns by length, names of items) of (item id, text) rows. Items without words give none."""
    w = words(pa.array([t for _, t in items], pa.string()), NOT_ALNUM, lower=True)
    names = sorted({i for i, _ in items if i is not None})
    number = {k: n for n, k in enumerate(names)}
    item = np.array([number.get(i, -1) for i, _ in items], np.int64)
    length = np.minimum(window, w.counts())
    out = []
    for n in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == n)
        many = w.counts()[rows] - n + 1
        first = np.repeat(w.first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        _, once, which = np.unique(np.stack([w.hashes[first + j] for j in range(n)], axis=1), axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.repeat(item[rows], many)], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        out.append(Patterns(n, w, first[once], np.searchsorted(pairs[:, 0], np.arange(len(once) + 1)), pairs[:, 1]))
    return out, names


def find(b: pa.RecordBatch, text: str, patterns: list[Patterns], names: list[str]) -> tuple[Words, np.ndarray, list[list[str]]]:
    """(words, which of them are hit, item ids of each row)."""
    w = words(b.column(text), NOT_ALNUM, lower=True)
    edge = np.zeros(len(w.starts) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for p in patterns:
        place, which = p.search(w)
        np.add.at(edge, place - p.length + 1, 1)
        np.add.at(edge, place + 1, -1)
        seen = np.unique(np.stack([w.row[place], which], axis=1), axis=0)
        many = p.cuts[seen[:, 1] + 1] - p.cuts[seen[:, 1]]
        at = np.repeat(p.cuts[seen[:, 1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pairs.append(np.stack([np.repeat(seen[:, 0], many), p.items[at]], axis=1))
    found = np.unique(np.concatenate(pairs), axis=0)
    cuts = np.searchsorted(found[:, 0], np.arange(b.num_rows + 1)).tolist()
    ids = found[:, 1].tolist()
    return w, np.cumsum(edge)[:-1] > 0, [[names[i] for i in ids[x:y]] for x, y in zip(cuts, cuts[1:])]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, hits (word ranges, end exclusive) and items (ids as strings, sorted as strings).

    A null or empty text has no words and no hits; an item without words matches nothing; a null item id hits words but
    is not listed; an item id that occurs in several rows is listed once. Columns of docs with these names are replaced.
    An empty benchmark gives no hits, an empty table an empty result. Repeated rows are judged each.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = 1 + size // BLOCK_BYTES
    old_hits, old_items = fresh(docs, "hits_before", "items_before")
    docs = drop_existing(docs, ["n_words", "n_hit", "hits", "items"])
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    for k in range(passes):
        rows = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        patterns = compile_patterns([(r["item"], r["text"]) for r in rows.toLocalIterator()], window)
        shared = docs.sparkSession.sparkContext.broadcast(patterns)  # of about BLOCK_BYTES of text
        first = k == 0

        def fn(b, shared=shared, first=first):
            w, hit, items = find(b, text, *shared.value)
            if not first:
                for r, (spans, more) in enumerate(zip(b.column(old_hits).to_pylist(), b.column(old_items).to_pylist(), strict=True)):
                    for s in spans:
                        hit[w.first[r] + s["start"] : w.first[r] + s["stop"]] = True
                    items[r] = sorted({*items[r], *more})
            begin = hit.copy()
            begin[1:] &= ~hit[:-1] | (w.row[1:] != w.row[:-1])
            last = hit.copy()
            last[:-1] &= ~hit[1:] | (w.row[1:] != w.row[:-1])
            s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
            cuts = np.searchsorted(s, w.first).astype(np.int32)
            base = w.first[w.row[s]] if len(s) else s
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(s - base, pa.int64()), pa.array(e - base, pa.int64())], names=["start", "stop"]))
            return {"n_words": w.counts(), "n_hit": np.bincount(w.row[hit], minlength=b.num_rows), "hits": spans.cast(SPANS), "items": items}

        if not first:
            docs = cut(docs, "hits").withColumnRenamed("hits", old_hits).withColumnRenamed("items", old_items)
        docs = map_batches(docs, "n_words long, n_hit long, hits array<struct<start: long, stop: long>>, items array<string>", fn, text)
        if not first:
            docs = docs.drop(old_hits, old_items)
    return docs


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def digests(found: DataFrame) -> DataFrame:
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.size("items") >= 2})


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which fewer than two benchmark items occur.

    A null or empty text holds none and stays; repeated rows and null keys are judged each; an empty table stays empty; columns
    of docs with the operator's names keep their own values."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    safe, back = shelter(docs, ["n_words", "n_hit", "hits", "items"])
    return back(find_contamination(safe, bench).where(F.size("items") < 2))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return digests(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op1_decontaminate": op1_decontaminate}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 8) AS n, list_slice(w, i, i + least(len(w), 8) - 1) AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (
            SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        its AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""
}
