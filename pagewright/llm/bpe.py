"""BPE encoding and decoding over a minimal acyclic transducer.

The most frequent words of the corpus (runs of anything but white space, lower-cased) are merged once on the driver
and compiled into a minimal acyclic automaton with shared suffixes. Its transitions carry numbers that add up to a
word's rank in sorted order, which indexes the words' ids. The automaton, the ids and the merge rules are one flat
binary file, handed to the executors by Spark and memory-mapped by their workers. The distinct words of a batch
walk the automaton together, one byte a step; words that it does not hold are merged exactly.

Ids and decoded texts equal those of the `tokenizers` library for files of this kind: NFC, white space dropped,
lower case, a word pattern, byte-level symbols, an end-of-word suffix and no decoder (tokens joined by blanks). Added
tokens are found in the raw text first.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import sys
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import buffers, cut, discard, in_arrow, map_batches, slices

LEXICON_WORDS = 50_000
LONGEST_WORD = 48  # bytes; longer words are merged, not looked up
BATCH = 2 << 20  # bytes of text that a worker encodes at a time; it keeps nothing between batches but the lexicon
SUFFIX = "</w>"

#: The tokenizer's white space beyond ASCII, and the letters and numbers that Unicode 16 has and Python's tables lack.
BLANK = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def char_class(kind: str, new: str) -> str:
    """Ranges of the code points whose general category starts with kind, and of the new ones, for use between brackets."""
    code = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    cuts = [0, *[i for i in range(1, len(code)) if code[i] != code[i - 1] + 1], len(code)]
    ranges = [(code[a], code[b - 1]) for a, b in zip(cuts, cuts[1:])] + [tuple(int(x, 16) for x in r.split("-")) for r in new.split()]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


_L, _N = char_class("L", NEW_LETTERS), char_class("N", NEW_NUMBERS)
#: Contractions, letters, one number, anything else but white space.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r {BLANK}{_L}{_N}]+")
BLANKS = re.compile(f"[{BLANK}]")
#: Beyond Latin and common punctuation, Unicode versions may differ in case and order of marks.
RARE = re.compile("[^\u0000-\u02ff\u2010-\u2027\u20ac]")


_NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


@functools.lru_cache(1)
def _library_rules():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def normalise(text: str) -> str:
    """NFC and lower case; texts with rare characters by the library's own tables. White space becomes ASCII white space."""
    if text.isascii():
        return text.lower()
    text = _library_rules().normalize_str(text) if RARE.search(text) else unicodedata.normalize("NFC", text).lower()
    return BLANKS.sub(" ", text)


def split_column(col: pa.Array) -> pa.ListArray:
    """The words (runs of anything but white space) of normalised texts, among them empty ones at the edges; null counts as empty."""
    col = pc.fill_null(col, "")
    plain = pc.string_is_ascii(col)
    low = pc.ascii_lower(col)
    if not pc.all(plain).as_py() and len(col):
        other = pc.invert(plain)
        low = pc.replace_with_mask(low, other, pa.array([normalise(t) for t in col.filter(other).to_pylist()], pa.string()))
    return pc.ascii_split_whitespace(low)


def gather(pool: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches pool[start : start + lens], one after the other."""
    ends = np.cumsum(lens)
    return pool[np.repeat(start - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    def __missing__(self, k):
        self[k] = n = len(self)
        return n


class Merger:
    """Exact BPE merges of whole words."""

    def __init__(self, tokens: list[str], merges: np.ndarray):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        symbols = byte_symbols()
        self.inner = [ids.get(s, -1) for s in symbols]
        self.last = [ids.get(s + SUFFIX, -1) for s in symbols]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        m = merges.astype(np.int64).reshape(-1, 3)
        keys = (m[:, 0] << 32) | m[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.results = keys[order], order, m[:, 2].copy()
        self.merges = m

    @functools.cached_property
    def rules(self) -> dict:
        """The rules as a dictionary, for long words only."""
        return {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges.tolist())}

    def piece(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        s = [self.inner[x] for x in raw[:-1]] + [self.last[raw[-1]]]
        s = [x for x in s if x >= 0]
        rules = self.rules
        if len(s) < 24:
            while len(s) > 1:
                best = min(((rules[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rules), default=None)
                if best is None:
                    break
                (_, c), i = best
                s[i : i + 2] = [c]
            return s
        n = len(s)  # long words: a heap of possible merges over a linked list
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rules[p], i, *p) for i, p in enumerate(zip(s, s[1:])) if p in rules]
        heap = [(r, i, a, b, c) for r, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = c, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (c, s[k])) in rules:
                    r, d = rules[p]
                    heapq.heappush(heap, (r, i, *p, d))
            if (h := before[i]) >= 0 and (p := (s[h], c)) in rules:
                r, d = rules[p]
                heapq.heappush(heap, (r, h, *p, d))
        return [x for x in s if x >= 0]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each's) of many: all words take their next merge (lowest rank, then leftmost) together, until none has one."""
        raw = [x.encode("utf-8", "replace") for x in pieces]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        short = np.flatnonzero(lens <= LONGEST_WORD)
        done_ids, done_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(lens > LONGEST_WORD).tolist():
            done_ids.append(np.array(self.piece(pieces[i]), np.int64))
            done_words.append(np.full(len(done_ids[-1]), i))
        lens = lens[short]
        data = np.frombuffer(b"".join([raw[i] for i in short.tolist()]), np.uint8)
        ids = self.inner_ids[data]
        ends = np.cumsum(lens)
        ids[ends - 1] = self.last_ids[data[ends - 1]]
        word = np.repeat(short, lens)
        keep = ids >= 0
        ids, word = ids[keep], word[keep]
        while len(ids):
            score = np.full(len(ids), _NONE)
            if len(self.pair_keys):
                at = np.searchsorted(self.pair_keys, key := (ids[:-1] << 32) | ids[1:])
                at[at == len(self.pair_keys)] = 0
                good = (self.pair_keys[at] == key) & (word[:-1] == word[1:])
                score[:-1][good] = (self.pair_ranks[at[good]] << 32) | np.flatnonzero(good)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(score, first)
            more = best < _NONE
            stay = np.repeat(more, np.diff(np.append(first, len(ids))))
            done_ids.append(ids[~stay])
            done_words.append(word[~stay])
            place = best[more] & 0xFFFFFFFF
            ids[place] = self.results[best[more] >> 32]
            stay[place + 1] = False
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(pieces))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each's) of many distinct words."""
        split = [WORD.findall(w) for w in words]
        count = np.fromiter(map(len, split), np.int64, len(split))
        number = _Numbers()
        which = np.fromiter((number[p] for x in split for p in x), np.int64, int(count.sum()))
        ids, lens = self.pieces(list(number))
        start = np.cumsum(lens) - lens
        total = np.concatenate([[0], np.cumsum(lens[which])])
        ends = np.cumsum(count)
        return gather(ids, start[which], lens[which]), total[ends] - total[ends - count]


def build_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words; the numbers on a word's path add up to its rank."""
    nodes: list[tuple] = []  # (final, number of words, ((label, target), ...)), children before parents
    registry: dict[tuple, int] = {}

    def close(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in registry:
            registry[key] = len(nodes)
            nodes.append((final, int(final) + sum(nodes[t][1] for _, t in edges), key[1]))
        return registry[key]

    path: list[list] = [[False, []]]
    last = b""
    for w in [*words, None]:
        same = 0 if w is None else len(os.path.commonprefix([last, w]))
        while len(path) > same + 1:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], close(final, edges)))
        if w is not None:
            path.extend([False, []] for _ in range(len(w) - same))
            path[-1][0] = True
            last = w
    root = close(*path[0])
    rows = []
    for i, (final, _, edges) in enumerate(nodes):
        skip = int(final)
        for label, t in edges:
            rows.append((i * 256 + label, t, skip))
            skip += nodes[t][1]
    rows.sort()
    e = np.array(rows, np.int64).reshape(-1, 3)
    return {"keys": e[:, 0].copy(), "targets": e[:, 1].astype(np.int32), "skips": e[:, 2].astype(np.int32), "finals": np.array([n[0] for n in nodes], np.uint8), "root": np.array([root], np.int64)}


def walk(a: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rank of each word of a column's bytes in the automaton, -1 where it has none; all words walk together."""
    start, lens = offsets[:-1], np.diff(offsets)
    n = len(lens)
    rank = np.zeros(n, np.int64)
    state = np.full(n, a["root"][0])
    live = np.flatnonzero(lens <= LONGEST_WORD) if len(a["keys"]) else np.zeros(0, np.int64)
    ok = np.zeros(n, bool)
    step = 0
    while len(live):
        done = lens[live] == step
        ok[live[done]] = a["finals"][state[live[done]]] > 0
        live = live[~done]
        if not len(live):
            break
        key = state[live] * 256 + raw[start[live] + step]
        at = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
        hit = a["keys"][at] == key
        live, at = live[hit], at[hit]
        state[live] = a["targets"][at]
        rank[live] += a["skips"][at]
        step += 1
    return np.where(ok, rank, -1)


def look_up(a: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    return walk(a, *buffers(pa.array(words, pa.binary()).cast(pa.string())))


def read_tokenizer(path: str) -> dict:
    """Tokens by id, merge rules as (left, right, result) ids, and the added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    vocab = d["model"]["vocab"]
    tokens = [""] * (max([*vocab.values(), *(t["id"] for t in d["added_tokens"])]) + 1)
    for t, i in vocab.items():
        tokens[i] = t
    added = {t["content"]: t["id"] for t in d["added_tokens"]}
    for t, i in added.items():
        tokens[i] = t
    pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
    return {"tokens": tokens, "merges": np.array([[vocab[x], vocab[y], vocab[x + y]] for x, y in pairs], np.int32).reshape(-1, 3), "added": added}


def write_lexicon(path: str, tokenizer: dict, words: list[str]) -> None:
    """One flat file: a header line in JSON, then the arrays, each at a multiple of 64 bytes."""
    merger = Merger(tokenizer["tokens"], tokenizer["merges"])
    raw = sorted({w.encode("utf-8", "replace") for w in words if w})
    ids, lens = merger.words([w.decode() for w in raw])
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    arrays = build_transducer(raw) | {"ends": ends, "ids": ids.astype(np.int32), "merges": tokenizer["merges"], "tokens": np.frombuffer("\0".join(tokenizer["tokens"]).encode(), np.uint8)}
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [at, str(v.dtype), list(v.shape)]
        at += -(-v.nbytes // 64) * 64
    line = json.dumps({"arrays": head, "added": tokenizer["added"]}).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    with open(path, "wb") as f:
        f.write(line)
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 64))


class Lexicon:
    """A memory-mapped lexicon file and the merges for all other words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            line = f.readline()
        head, raw = json.loads(line), np.memmap(path, np.uint8, "r")
        a = {k: raw[len(line) + at : len(line) + at + int(np.prod(shape)) * np.dtype(kind).itemsize].view(np.ndarray).view(kind).reshape(shape) for k, (at, kind, shape) in head["arrays"].items()}
        self.automaton = {k: a[k] for k in ("keys", "targets", "skips", "finals", "root")}
        self.ends, self.ids = a["ends"], a["ids"]
        tokens = a["tokens"].tobytes().decode().split("\0")
        self.tokens = pa.array(tokens, pa.string())
        self.merger = Merger(tokens, a["merges"])
        self.added = head["added"]
        self.find = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number of each's) of distinct words: from the automaton, else merged."""
        rank = walk(self.automaton, *buffers(words))
        known, other = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        start, lens = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        lens[known] = self.ends[rank[known] + 1] - self.ends[rank[known]]
        mapped = gather(self.ids, self.ends[rank[known]], lens[known])
        start[known] = np.cumsum(lens[known]) - lens[known]
        merged, lens[other] = self.merger.words(words.take(pa.array(other)).to_pylist())
        start[other] = len(mapped) + np.cumsum(lens[other]) - lens[other]
        return np.concatenate([mapped, merged]), start, lens

    def stretches(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(texts between added tokens, row of each, id of the added token that follows it or -1)."""
        rows = np.arange(len(col))
        if not any(pc.any(pc.match_substring(col, t)).as_py() for t in self.added):
            return col, rows, np.full(len(col), -1)
        texts, at, after = [], [], []
        for r, t in enumerate(col.to_pylist()):
            begin = 0
            for m in self.find.finditer(t or ""):
                texts.append(t[begin : m.start()])
                at.append(r)
                after.append(self.added[m[0]])
                begin = m.end()
            texts.append((t or "")[begin:])
            at.append(r)
            after.append(-1)
        return pa.array(texts, pa.string()), np.array(at), np.array(after)


def encode_column(lex: Lexicon, col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids of all texts, where each text's ids begin and the last one's end, decoded texts)."""
    texts, row, after = lex.stretches(col)
    split = split_column(texts)
    coded = split.values.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    pool, start, lens = lex.word_ids(coded.dictionary)
    ids = gather(pool, start[which], lens[which])
    bounds = np.concatenate([[0], np.cumsum(lens[which])])[split.offsets.to_numpy()]
    n = np.diff(bounds) + (after >= 0)
    if (after >= 0).any():
        ids = np.insert(ids, bounds[1:][after >= 0], after[after >= 0])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, n, minlength=len(col)).astype(np.int64))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lex.tokens.take(pa.array(ids))), " ")
    return ids.astype(np.uint32), bounds, joined


def encode_batch(lex: Lexicon, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """encode_column() of a list."""
    ids, bounds, decoded = encode_column(lex, pa.array(texts, pa.string()))
    return ids, bounds, decoded.to_pylist()


@functools.lru_cache(1)
def _open(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, in eighths of a power of two of their counts: at most `most` of them."""

    def count(batches):
        for whole in batches:
            for b in slices(whole, text, 2 * BATCH):
                got = pc.value_counts(split_column(b.column(text)).values)
                got = got.filter(pc.and_(pc.greater(pc.binary_length(got.field(0)), 0), pc.less_equal(pc.binary_length(got.field(0)), LONGEST_WORD)))
                yield pa.RecordBatch.from_arrays([got.field(0), got.field(1)], names=["word", "n"])

    counts = cut(in_arrow(docs.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # A sorted limit would bring `most` rows of every partition to the driver; the histogram of counts has some hundred.
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, edge, room, share = 1 << 30, -1, most, 0.0
    for at, words in histogram:
        if words > room:  # of the step that does not fit whole, as many as fit, by hash
            edge, share = at, room / words
            break
        least, room = at, room - words
    some = (step == edge) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = sorted(r["word"] for r in counts.where((step >= least) | some).select("word").toLocalIterator())
    discard(counts)
    return chosen


def compile_lexicon(spark, path: str, words: list[str]) -> str:
    """Builds the lexicon file and hands it to all executors; returns its name there."""
    local = os.path.join(tempfile.mkdtemp(), "lexicon")
    write_lexicon(local, read_tokenizer(path), words)
    with open(local, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}"
    if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
        os.rename(local, local := os.path.join(os.path.dirname(local), name))
        spark.sparkContext.addFile(local)
    return name


def bpe(docs: DataFrame, path: str, text: str = "text", lexicon: str | None = None) -> DataFrame:
    """docs with n_tokens, ids (little-endian unsigned 32-bit integers) and decoded.

    path: the tokenizer file, read on the driver only. lexicon: a name from compile_lexicon; by default one is compiled
    from docs. A null or blank text has no ids and an empty decoded text. Columns named n_tokens, ids or decoded are
    replaced. An empty table gives an empty result.
    """
    name = lexicon or compile_lexicon(docs.sparkSession, path, frequent_words(docs, text))

    def fn(b):
        ids, bounds, decoded = encode_column(_open(name), b.column(text))
        offsets = (bounds * 4).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(decoded), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
        return {"n_tokens": np.diff(bounds), "ids": binary, "decoded": decoded}

    return map_batches(docs, "n_tokens long, ids binary, decoded string", fn, text, BATCH)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of a column of ids as bpe() makes them; null ids give an empty text."""
    tokens = df.sparkSession.sparkContext.broadcast(read_tokenizer(path)["tokens"])  # the vocabulary: bounded by the file

    def fn(b):
        t = tokens.value
        return {"decoded": [" ".join([t[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in b.column(ids).to_pylist()]}

    return map_batches(df, "decoded string", fn)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _digests(docs: DataFrame) -> DataFrame:
    out = bpe(docs.select("doc_id", "text"), default_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: n_tokens of every document, and digests of its ids and of their decoded text.

    A null or empty text has no ids; repeated rows and null keys are encoded each; an empty table gives an empty result; other
    columns are not read."""
    return _digests(docs)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return _digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
