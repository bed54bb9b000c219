"""Pages, tensors and regions in files, read by Spark's own readers from wherever Spark can read."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit greyscale PNG without interlacing as height x width bytes."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed = 8, None, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError(f"depth {depth}, colour {colour}, interlace {interlace}: not 8-bit greyscale")
            size = height, width
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += n + 12
    if size is None:
        raise ValueError("no IHDR")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[0], size[1] + 1)
    out, above = np.zeros(size, np.uint8), np.zeros(size[1], np.uint8)
    for y, (kind, row) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:], strict=True)):
        if kind == 0:
            line = row
        elif kind == 1:
            line = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            line = row + above
        elif kind in (3, 4):
            line, left, corner = np.zeros_like(row), 0, 0
            for x, (v, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                near = left + up - corner
                guess = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda c: abs(near - c))  # noqa: B023
                line[x] = left = (v + guess) & 255
                corner = up
        else:
            raise ValueError(f"filter {kind}")
        out[y] = above = line
    return out


def _read(spark: SparkSession, path: str, columns: str, fn) -> DataFrame:
    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row, error = None, None
                try:
                    row = fn(data.as_py())
                except (ValueError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                height, width, values = row if row else (None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([height], pa.int64()), pa.array([width], pa.int64()), pa.array([values], pa.list_(pa.float32())), pa.array([error], pa.string())], names=["path", "height", "width", "values", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, columns)


COLUMNS = "path string, height long, width long, values array<float>, error string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, values, error) of greyscale PNG files; what cannot be read has an error and no values."""

    def page(data):
        img = decode_png(data)
        return img.shape[0], img.shape[1], img.ravel().astype(np.float32)

    return _read(spark, path, COLUMNS, page)


def read_tensors(spark: SparkSession, path: str, half: bool) -> DataFrame:
    """The same of files of raw little-endian numbers, two bytes each if half, else four: one row of `width` numbers."""

    def tensor(data):
        v = np.frombuffer(data, "<f2" if half else "<f4").astype(np.float32)
        return 1, len(v), v

    return _read(spark, path, COLUMNS, tensor)


def write_regions(regions: DataFrame, path: str) -> None:
    regions.write.mode("overwrite").json(path)


def read_regions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Regions as write_regions has left them; fields of other names are dropped, missing ones are null."""
    return spark.read.schema(schema).json(path)


def write_tiers(outputs: DataFrame, path: str) -> None:
    """One folder for each tier."""
    outputs.write.mode("overwrite").partitionBy("tier").parquet(path)
