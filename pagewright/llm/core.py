"""Shared pieces: the shared folder, Arrow batches, word hashing on UTF-8 buffers, components.

Words are cut and hashed on the bytes of an Arrow string column, so that a batch of texts costs a few
numpy passes and no Python loop over words. All delimiters used here are ASCII bytes, which never occur
inside a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text hashed at a time; bounds the worker's scratch memory for texts of any length.
PIECE_BYTES = 512 << 10
#: Join keys, for each shuffle partition, over which the rows of one key are dealt.
SALTS = 8
#: Rows and bytes of the Arrow batches that Spark hands to a worker, where the session leaves them open.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20
#: Edges from which components() needs no more rounds: 8 MB, in one task. Each round's plans cost the driver memory.
FEW_EDGES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. In local mode a temporary one where that is unset; on a cluster
    an error, because each machine would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Deletes what cut() has written, once nothing reads it any more."""
    for df in cuts:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, unless the session has set its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in spark.conf.getAll:
            spark.conf.set(key, str(most))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of bounded size; a worker gives its memory back after each task."""
    small_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _POWERS.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return df.mapInArrow(lean, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that df does not have yet."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def drop_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator is about to add (its own columns win over clashing input columns)."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def shelter(df: DataFrame, names: list[str]):
    """(df with its columns of these names renamed, a function that gives a frame made from it df's columns again)."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    new = dict(zip(clash, fresh(df, *[f"kept_{c}" for c in clash]), strict=True))
    return df.withColumnsRenamed(new), lambda out: out.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns])


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(b: pa.RecordBatch, text: str | None, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` bytes in the column text (a longer row stands alone)."""
    if text is None or b.num_rows < 2:
        yield b
        return
    _, offsets = buffers(b.column(text))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield b.slice(i, j - i)
        i = j


def map_batches(df: DataFrame, add: str, fn, text: str | None = None, most: int = 8 << 20) -> DataFrame:
    """df with the columns of the DDL string `add`, which fn(batch) returns as a dict of arrays.

    Batches hold at most `most` bytes in the column text, if one is named. Columns of df with added names are replaced.
    """
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(add)
    base = drop_existing(df, extra.names)
    schema = StructType(base.schema.fields + extra.fields)
    kinds = [pa.field(f.name, arrow_type(f.dataType)) for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, most):
                if b.num_rows:
                    got = fn(b)
                    cols = [c if isinstance(c, pa.Array) and c.type == k.type else pa.array(c, type=k.type) for c, k in ((got[k.name], k) for k in kinds)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *cols], schema=pa.schema([*b.schema, *kinds]))

    return in_arrow(base, run, schema)


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, PIECE_BYTES + 4096)
        up, down = np.full(n, _BASE, U64), np.full(n, _INV, U64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a batch: starts and ends in raw, the row of each, the first word of each row, 64-bit hashes."""

    def __init__(self, raw, offsets, starts, ends, hashes):
        self.raw, self.offsets, self.starts, self.ends, self.hashes = raw, offsets, starts, ends, hashes
        self.first = np.searchsorted(starts, offsets)  # of each row, and the end of the last
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)  # after lower-casing: everything ASCII but digits and a-z
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(col: pa.Array, delimiter: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Cuts a string column into words and hashes them."""
    raw, offsets = buffers(col)
    if lower:
        raw = LOWER[raw]
    gap = delimiter[raw]
    inside = ~gap
    before = np.empty(len(raw), bool)
    after = np.empty(len(raw), bool)
    if len(raw):
        before[0] = after[-1] = True
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
        edge = offsets[(offsets > 0) & (offsets < len(raw))]
        before[edge] = True
        after[edge - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    hashes = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):  # pieces of whole words
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, side="right")))
        a, b = starts[i], ends[j - 1]
        up, down = _powers(int(b - a) + 1)
        sums = np.zeros(int(b - a) + 1, U64)
        np.cumsum(_BYTES[raw[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        i = j
    return Words(raw, offsets, starts, ends, hashes)


def gram_hashes(h: np.ndarray, k: int, seed: int = 0x51A5EED5) -> np.ndarray:
    """Hashes of the runs of k values that start at each place but the last k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factor = np.uint64((seed * 2 + 1) * 0x2545F4914F6CDD1D & (2**64 - 1))
    out = h[:n].copy()
    for j in range(1, k):
        out *= factor
        out += h[j : j + n]
    return mix(out ^ U64(seed))


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], by: Column, how: str = "left") -> DataFrame:
    """rows joined with table, which has one row for each key. A key may hold any share of rows: rows of a key are
    dealt over SALTS join keys for each partition, and table follows only to the (key, salt) pairs that occur."""
    (salt,) = fresh(rows, "salt")
    salts = SALTS * parts(rows.sparkSession)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    pairs = salted.groupBy(*keys, salt).agg(F.lit(1).alias("n_")).drop("n_").join(table, keys, "inner")
    return salted.join(pairs, [*keys, salt], how).drop(salt)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges, itself included.

    Rounds of contraction: every node points at its smallest neighbour, pointers are squared until they end in
    roots, and edges move to the roots. Nodes with many edges cost partial minima only; each round is written to
    the shared folder. The number of rounds is logarithmic. Once no more than FEW_EDGES between long nodes are left, one task
    ends it.
    """
    todo = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    maps = []
    while left := todo.count():
        if left <= FEW_EDGES and {kind for _, kind in todo.dtypes} == {"bigint"}:
            maps.append(cut(in_arrow(todo.coalesce(1), few_components, "node long, root long"), "points"))
            break
        both = todo.unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "points")
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            nxt = cut(salted_lookup(point.select("node", "root"), up, ["root"], F.col("node")).select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "points")
            discard(point)
            point = nxt
            if nxt.where("moved").isEmpty():
                break
        maps.append(point)
        root = point.select("node", "root")
        moved = salted_lookup(todo.withColumnRenamed("a", "node"), root, ["node"], F.col("b")).select(F.col("node").alias("start"), F.col("root").alias("a"), "b")
        moved = salted_lookup(moved.withColumnRenamed("b", "node"), root, ["node"], F.col("start")).select("a", F.col("root").alias("b"))
        before, todo = todo, cut(moved.where("a <> b").distinct(), "edges")
        discard(before)
    discard(todo)
    if not maps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).where("false")
    out = maps[0].select("node", "root")
    for m in maps[1:]:
        up = m.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = salted_lookup(out, up, ["root"], F.col("node")).select("node", F.coalesce("up", "root").alias("root"))
    if len(maps) > 1:
        out = cut(out, "components")
        discard(*maps)
    return out


def few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (a, b), all of which one task holds; rounds as in components(), in numpy."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([x for x, _ in ends] + [y for _, y in ends]), return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))  # no place has a larger root than itself
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    for s in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + 100_000]), pa.array(nodes[root[s : s + 100_000]])], names=["node", "root"])


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
