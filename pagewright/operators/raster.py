"""Images as pixel relations (img, y, x, v): filters over windows, resampling over one array an image, masks."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def grey(r: Column, g: Column, b: Column) -> Column:
    """Integer luminance (299 R + 587 G + 114 B + 500) / 1000."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def chroma(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def dilate(mask: DataFrame, radius: int, value: str = "m") -> DataFrame:
    """Square dilation, separably: the largest value within radius along rows, then along columns."""
    rows = Window.partitionBy("img", "y").orderBy("x").rangeBetween(-radius, radius)
    columns = Window.partitionBy("img", "x").orderBy("y").rangeBetween(-radius, radius)
    return mask.withColumn(value, F.max(value).over(rows)).withColumn(value, F.max(value).over(columns))




def shifted(value: Column, k: int, along: str, across: str) -> Column:
    """The value k places on along an axis, the edge's own where there is none."""
    w = Window.partitionBy("img", across).orderBy(along)
    return F.coalesce((F.lead if k > 0 else F.lag)(value, abs(k)).over(w), value)


def unsharp5(pixels: DataFrame, amount: float, value: str = "g") -> DataFrame:
    """v + amount * (v - mean of itself and its four neighbours), truncated and kept within 0..255."""
    v = F.col(value)
    near = pixels.withColumns({"__l": shifted(v, -1, "x", "y"), "__r": shifted(v, 1, "x", "y")}).withColumns({"__u": shifted(v, -1, "y", "x"), "__d": shifted(v, 1, "y", "x")})
    mean = (v + F.col("__l") + F.col("__r") + F.col("__u") + F.col("__d")) / 5
    return near.withColumn(value, F.greatest(F.lit(0), F.least(F.lit(255), (v + amount * (v - mean)).cast("int")))).drop("__l", "__r", "__u", "__d")


def unsharp9(pixels: DataFrame, amount: float, value: str = "g") -> DataFrame:
    """The same with the 3 x 3 mean, rounded half up."""
    v = F.col(value)
    row = pixels.withColumn("__s", v + shifted(v, -1, "x", "y") + shifted(v, 1, "x", "y"))
    s = F.col("__s")
    total = row.withColumn("__t", s + shifted(s, -1, "y", "x") + shifted(s, 1, "y", "x"))
    return total.withColumn(value, F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + amount * (v - F.col("__t") / 9) + 0.5).cast("int")))).drop("__s", "__t")


def nearest_index(i: Column, src: int, dst: int) -> Column:
    """min(floor(i * (1 / (dst / src))), src - 1): the double division is part of the rule."""
    return F.least(F.floor(i * F.lit(1.0 / (dst / src))).cast("int"), F.lit(src - 1))


def whole_images(pixels: DataFrame, size: int, value: str) -> DataFrame:
    """(img, a): the size x size values of each image as one array, row by row, after one exchange of its pixels. An image that lacks
    pixels or repeats some is an error."""
    at = (F.col("y") * size + F.col("x")).cast("int")
    rows = pixels.groupBy("img").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(value).alias("v")))).alias("c"))
    whole = F.transform("c", lambda p: p["at"]) == F.sequence(F.lit(0), F.lit(size * size - 1))
    return rows.select("img", F.when(whole, F.transform("c", lambda p: p["v"])).otherwise(F.raise_error(F.lit(f"an image is not whole: {size} x {size} pixels"))).alias("a"))


def sample(pixels: DataFrame, src: int, dst: int, value: str, place) -> DataFrame:
    """(img, y, x, value) of dst x dst target places; place(tap, y, x) makes a value of the source pixels that tap(y, x) looks up in the
    image's array, so that only results leave it."""
    tap = lambda y, x: F.get("a", (y * src + x).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(dst * dst - 1)), lambda i: place(tap, F.floor(i / dst).cast("int"), i % dst))
    out = whole_images(pixels, src, value).select("img", F.posexplode(cells).alias("i", value))
    return out.select("img", F.floor(F.col("i") / dst).cast("int").alias("y"), (F.col("i") % dst).alias("x"), value)


def resample_nearest(pixels: DataFrame, src: int, dst: int, value: str = "v") -> DataFrame:
    return sample(pixels, src, dst, value, lambda tap, y, x: tap(nearest_index(y, src, dst), nearest_index(x, src, dst)))


def blend(tap, y0: Column, y1: Column, fy: Column, x0: Column, x1: Column, fx: Column) -> Column:
    """The bilinear value between four taps."""
    return (1 - fy) * ((1 - fx) * tap(y0, x0) + fx * tap(y0, x1)) + fy * ((1 - fx) * tap(y1, x0) + fx * tap(y1, x1))


def resample_bilinear(pixels: DataFrame, src: int, dst: int, value: str = "v") -> DataFrame:
    """Half-pixel centres, kept within the image; the taps of an axis are constants of the plan."""
    pos = [max(0.0, min(src - 1.0, (c + 0.5) * (src / dst) - 0.5)) for c in range(dst)]
    low = [math.floor(p) for p in pos]
    taps = [F.lit(x) for x in (low, [min(i + 1, src - 1) for i in low], [p - i for p, i in zip(pos, low, strict=True)])]
    return sample(pixels, src, dst, value, lambda tap, y, x: blend(tap, *[F.get(t, c) for c in (y, x) for t in taps]))


def resample_area(pixels: DataFrame, src: int, dst: int, value: str = "v") -> DataFrame:
    """Mean over the covered source area."""
    scale = src / dst
    cells = lambda c: F.sequence(F.floor(c * scale).cast("int"), F.least(F.ceil((c + 1) * scale).cast("int") - 1, F.lit(src - 1)))
    share = lambda c, k: (F.least((c + 1) * scale, k + 1.0) - F.greatest(c * scale, k.cast("double"))) / scale

    def mean(tap, y, x):
        row = lambda j: F.aggregate(cells(x), F.lit(0.0), lambda t, i: t + share(x, i) * tap(j, i))
        return F.aggregate(cells(y), F.lit(0.0), lambda t, j: t + share(y, j) * row(j))

    return sample(pixels, src, dst, value, mean)


def warp(pixels: DataFrame, src: int, dst: int, h: list[float], value: str = "v") -> DataFrame:
    """Bilinear values at the places to which a homography (eight numbers, row by row, the ninth 1) takes the target places."""

    def taps(at):
        inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(src - 1), c)).cast("int")
        low = F.floor(at)
        return inside(low), inside(low + 1), at - low

    def place(tap, y, x):
        w = h[6] * x + h[7] * y + 1
        return blend(tap, *taps((h[3] * x + h[4] * y + h[5]) / w), *taps((h[0] * x + h[1] * y + h[2]) / w))

    return sample(pixels, src, dst, value, place)


def fill_from_sides(pixels: DataFrame, mask: str, value: str, reach: int) -> DataFrame:
    """Masked pixels get the mean of the nearest unmasked ones to the left, right, above and below, within reach."""
    clear = F.when(~F.col(mask), F.col(value))
    out = pixels
    for name, along, across in (("h", "x", "y"), ("v", "y", "x")):
        w = Window.partitionBy("img", across).orderBy(along)
        out = out.withColumn(f"__{name}0", F.last(clear, ignorenulls=True).over(w.rowsBetween(-reach, -1))).withColumn(f"__{name}1", F.first(clear, ignorenulls=True).over(w.rowsBetween(1, reach)))
    sides = [F.col(f"__{n}{k}") for n in "hv" for k in "01"]
    got = F.filter(F.array(*sides), lambda x: x.isNotNull())
    mean = F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(got), F.lit(0))
    return out.withColumn(value, F.when(F.col(mask), F.coalesce(mean, F.col(value).cast("double"))).otherwise(F.col(value).cast("double"))).drop(*[f"__{n}{k}" for n in "hv" for k in "01"])


def components8(mask: DataFrame, size: int) -> DataFrame:
    """(img, y, x, comp): 8-connected components of (img, y, x), named by their least y * size + x. An image is one array and one
    row, searched once: time and memory follow its marked pixels."""

    def label(on: list[int]) -> list[int]:
        out = dict.fromkeys(on, -1)
        for start in sorted(out):
            if out[start] >= 0:
                continue
            out[start], todo = start, [start]
            while todo:
                p = todo.pop()
                x = p % size
                for q in (p + dy + dx for dy in (-size, 0, size) for dx in (-1, 0, 1) if 0 <= x + dx < size):
                    if out.get(q) == -1:
                        out[q] = start
                        todo.append(q)
        return [out[p] for p in on]

    def run(batches):
        for b in batches:
            on = b.column("on")
            flat = pa.array([c for cells in on.to_pylist() for c in label(cells)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("img"), on, pa.ListArray.from_arrays(pc.subtract(on.offsets, on.offsets[0]), flat)], names=["img", "on", "comp"])

    rows = mask.groupBy("img").agg(F.collect_set((F.col("y") * size + F.col("x")).cast("int")).alias("on"))
    found = rows.mapInArrow(run, StructType([rows.schema["img"], *StructType.fromDDL("on array<int>, comp array<int>").fields]))
    cells = found.select("img", F.explode(F.arrays_zip("on", "comp")).alias("c"))
    return cells.select("img", F.floor(F.col("c.on") / size).cast("int").alias("y"), (F.col("c.on") % size).alias("x"), F.col("c.comp").alias("comp"))


def component_boxes(components: DataFrame) -> DataFrame:
    """(img, comp, x0, y0, x1, y1, n): the upright box of each component, ends exclusive."""
    return components.groupBy("img", "comp").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("n"))


def dilation_radius(width: float) -> int:
    """Half the width, rounded half up, at least 1."""
    return max(1, math.floor(width / 2 + 0.5))


def strip(pixels: DataFrame, margin: int) -> DataFrame:
    """(img, y, x, v) of strips of grey levels, -1 to 1, with a white margin to the right; a row of a strip is one array."""
    rows = pixels.groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "g"))), lambda p: (p["g"] - 127.5) / 127.5).alias("v"))
    return rows.select("img", "y", F.posexplode(F.concat("v", F.array_repeat(F.lit(1.0), margin))).alias("x", "v"))


def budget(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Size within a pixel budget: unchanged, or scaled by sqrt(most / (w h)), floored, at least 1."""
    k = F.sqrt(F.lit(float(most)) / (w * h))
    fit = lambda c: F.when(w * h <= most, c).otherwise(F.greatest(F.lit(1), F.floor(c * k).cast("int")))
    return fit(w), fit(h)


def fits_page(mw: Column, mh: Column, pw: Column, ph: Column) -> Column:
    """Whether a mask has a page's shape: both sizes positive and cross products within two pixels' worth."""
    return (mw > 0) & (mh > 0) & (pw > 0) & (ph > 0) & (F.abs(mw * ph - mh * pw) <= 2 * (mw + mh + pw + ph))
