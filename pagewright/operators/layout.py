"""Text placement: cells, font size, columns with line-start rules, and the places of cells."""

from __future__ import annotations

import math
import re
from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

TRIM, LEAST, MOST, SCALE = 3, 9, 60, 0.85
#: Characters that may not start a column or line.
NO_START = "!),.:;?]}、。，．・：；？！」』】〕〉》）］｝ーゝゞ々…"
#: Marks that stand on their side in vertical text.
SIDEWAYS = "()[]{}<>-~…ー―「」『』（）〈〉《》【】"


def vertical_cells(text: Column, merge: bool = True) -> Column:
    """Runs of two to four ASCII letters, digits, ! or ? share a cell; every other character has its own."""
    t = F.replace(text, F.lit("\n"), F.lit(""))
    c = "[0-9A-Za-z!?]"
    return F.regexp_extract_all(t, F.lit(rf"(?s)(?<!{c}){c}{{2,4}}(?!{c})|." if merge else "(?s)."), 0)


def per_column(room: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), (room / (size * 1.05)).cast("int") - TRIM)


def vertical_size(n_cells: Column, width: Column, room: Column) -> Column:
    """The largest size whose columns fit the width, scaled down; LEAST where none fits."""
    most = F.least(room.cast("int"), F.lit(MOST))
    sizes = F.when(most >= LEAST, F.sequence(F.lit(LEAST), F.greatest(most, F.lit(LEAST)))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda s: F.ceil(n_cells / per_column(room, s)) * 1.1 * s <= width)
    return F.greatest(F.lit(LEAST), F.floor(F.coalesce(F.array_max(fits), F.lit(LEAST)) * SCALE + 0.5).cast("int"))


def columns(cells: Column, capacity: Column) -> Column:
    """Arrays of cells: a column takes up to two marks more that may not start the next one."""
    bad = lambda c: F.when((F.length(c) == 1) & (F.instr(F.lit(NO_START), c) > 0), "1").otherwise("0")
    return F.transform(_column_bounds(F.array_join(F.transform(cells, bad), ""), capacity), lambda r: F.slice(cells, r["at"], r["n"]))


@F.arrow_udf(returnType=ArrayType(StructType().add("at", IntegerType()).add("n", IntegerType())))
def _column_bounds(flags: pa.Array, capacity: pa.Array) -> pa.Array:
    """Place (from 1) and length of each column over cells flagged 1 where they may not start one; a step for each column, not each cell."""

    ends, at, n = [], array("i"), array("i")
    for marks, most in zip(flags.to_pylist(), capacity.to_pylist(), strict=True):
        ends.append(None if marks is None or most is None else len(at))
        start = 0
        while ends[-1] is not None and start < len(marks):
            end = min(start + most, len(marks))
            stop = min(end + 2, len(marks))
            while end < stop and marks[end] == "1":
                end += 1
            at.append(start + 1)
            n.append(end - start)
            start = end
    columns = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["at", "n"])
    return pa.ListArray.from_arrays(pa.array([*ends, len(at)], pa.int32()), columns)


def text_colour(mono: Column, on_art: Column, luminance: Column) -> Column:
    """Fill and outline: white on black only off art, in colour mode, over dark ground."""
    return F.when(~mono & ~on_art & (luminance < 110), "white/black").otherwise("black/white")


def stroke_width(size: Column, on_art: Column) -> Column:
    return F.greatest(F.lit(2.0), size * F.when(on_art, 0.16).otherwise(0.10))


#: Characters of one em under the fixed-advance metric; any other has half an em.
WIDE = re.compile("[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]")


def wrap_lines(text: str, half_ems: float, most: float = math.inf) -> list[str] | None:
    """Lines of at most half_ems; a line that is full still takes a mark that may not start the next one. None beyond `most` lines."""
    out, start, w = [], 0, 0
    for i, c in enumerate(text):
        if c == "\n":
            out.append(text[start:i])
            start, w = i + 1, 0
            continue
        a = 2 if WIDE.match(c) else 1
        if i > start and w + a > half_ems and c not in NO_START:
            out.append(text[start:i])
            start, w = i, 0
            if len(out) >= most:
                return None
        w += a
    if start < len(text):
        out.append(text[start:])
    return out if len(out) <= most else None


def fit_lines(text: str, width: float, room: float) -> tuple[int, list[str]]:
    """Font size and lines: the largest size whose lines, TRIM characters short, fit width and room, scaled down; LEAST where none
    fits. A size that does not fit is left at its first line too many."""
    half_ems = lambda s: max(width - TRIM * s, s) / (s / 2)
    size = LEAST
    for s in range(min(int(room), MOST), LEAST - 1, -1):
        ls = wrap_lines(text, half_ems(s), room / (s * 1.18))
        if ls is not None and len(ls) * s * 1.18 <= room and max((len(x) + len(WIDE.findall(x)) for x in ls), default=0) * s / 2 <= width:
            size = s
            break
    size = max(LEAST, math.floor(size * SCALE + 0.5))
    return size, wrap_lines(text, half_ems(size))


@F.arrow_udf(returnType=StructType().add("size", IntegerType()).add("lines", ArrayType(StringType())))
def horizontal_fit(text: pa.Array, width: pa.Array, room: pa.Array) -> pa.Array:
    """fit_lines of each row."""
    rows = zip(text.to_pylist(), width.to_pylist(), room.to_pylist(), strict=True)
    got = [None if None in r else dict(zip(("size", "lines"), fit_lines(*r), strict=True)) for r in rows]
    return pa.array(got, pa.struct([("size", pa.int32()), ("lines", pa.list_(pa.string()))]))
