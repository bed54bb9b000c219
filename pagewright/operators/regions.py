"""Rules for single regions, boxes and quadrilaterals, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Point, inside

#: Code point ranges that count as CJK text.
CJK = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF)]
#: Smallest side of a box that is drawn or looked at, angle from which a box is turned, size of a context window.
LEAST_SIDE, TURN, CONTEXT = 8, 1.0, 1.7
#: A bubble's ground is even and light; two colours this near are one; lightness counts less.
BUBBLE_STD, BUBBLE_MEAN, NEAR_COLOUR, LIGHTNESS = 24, 190, 30, 0.392
MARGIN = 16  # fixed value: white columns to the right of a strip


def readable(text: Column) -> Column:
    """Whether a text has anything but white space; null has not."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def renderable(translated: Column, source: Column, w: Column, h: Column) -> Column:
    """Whether a region is drawn: some text (the translation, else the source) and a box that is large enough."""
    return (readable(translated) | readable(source)) & (w >= LEAST_SIDE) & (h >= LEAST_SIDE)


def is_cjk(text: Column) -> Column:
    return text.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK) + "]")


def vertical(mode: Column, direction: Column) -> Column:
    """Whether text runs downwards: as asked for, else as the region does."""
    return F.when(mode == "vertical", True).when(mode == "horizontal", False).otherwise(direction == "v")


def layout_box(angle: Column, box: dict[str, Column], cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """The box to lay text out in: around the centre where the region is turned, else the upright one."""
    turned = F.abs(angle) >= TURN
    pick = lambda a, b: F.when(turned, a).otherwise(b)
    return {"x1": pick(cx - w / 2, box["x1"]), "y1": pick(cy - h / 2, box["y1"]), "x2": pick(cx + w / 2, box["x2"]), "y2": pick(cy + h / 2, box["y2"])}


def rect_corners(cx: Column, cy: Column, ux: Column, uy: Column, w: Column, h: Column) -> list[Point]:
    """Corners of a rectangle with the axis (ux, uy), from the one against both axes on, along the axis first."""
    return [(cx + (i * w * ux - j * h * uy) / 2, cy + (i * w * uy + j * h * ux) / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def clamp(points: list[Point], w: Column, h: Column) -> list[Point]:
    within = lambda v, most: F.greatest(F.lit(0.0), F.least(most - 1.0, v))
    return [(within(x, w), within(y, h)) for x, y in points]


def scale(points: list[Point], s: Column) -> list[Point]:
    return [(x * s, y * s) for x, y in points]


def support(low: Column, high: Column, cells: int, size: float) -> tuple[Column, Column]:
    """First cell and the one after the last that a stretch covers on a mask of `cells` for `size` pixels; nothing if not ascending."""
    return F.greatest(F.lit(0), (low * cells / size).cast("int")), F.least(F.lit(cells), F.ceil(high * cells / size).cast("int"))


def context_window(box: dict[str, Column], w: float, h: float, ratio: float = CONTEXT) -> dict[str, Column]:
    """A box grown around its centre, whole numbers within the page; the caller drops those smaller than LEAST_SIDE."""
    out = {}
    for a, b, most in (("x1", "x2", w), ("y1", "y2", h)):
        centre, half = (box[a] + box[b]) / 2, (box[b] - box[a]) * ratio / 2
        out[a], out[b] = F.greatest(F.lit(0), (centre - half).cast("int")), F.least(F.lit(int(most)), (centre + half).cast("int"))
    return out


def cubic_weight(t: Column, a: float) -> Column:
    """Cubic convolution kernel."""
    x = F.abs(t)
    return F.when(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1).when(x < 2, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a).otherwise(0.0)


def is_bubble(mean: Column, std: Column) -> Column:
    return (std < BUBBLE_STD) & (mean >= BUBBLE_MEAN)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of an sRGB colour on the scale of whole bytes."""
    lin = [F.when(c <= 0.04045 * 255, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    rows = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
    x, y, z = [(k[0] * lin[0] + k[1] * lin[1] + k[2] * lin[2]) / k[3] for k in rows]
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return F.floor(light * 2.55 + 0.5), F.floor(500 * (f(x) - f(y)) + 128.5), F.floor(200 * (f(y) - f(z)) + 128.5)


def colour_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    (l1, a1, b1), (l2, a2, b2) = lab(*a), lab(*b)
    return F.sqrt(F.pow((l1 - l2) * LIGHTNESS, F.lit(2)) + F.pow(a1 - a2, F.lit(2)) + F.pow(b1 - b2, F.lit(2)))


def outline(fill: tuple[Column, Column, Column], ground: tuple[Column, Column, Column]) -> Column:
    """Outline of coloured text as an array: the ground, or white around dark and black around light text that is too near to it."""
    flip = F.when((fill[0] + fill[1] + fill[2]) / 3 <= 127, F.lit(255)).otherwise(F.lit(0))
    near = colour_distance(fill, ground) < NEAR_COLOUR
    return F.array(*[F.when(near, flip).otherwise(c) for c in ground])


def dark_text(fill: tuple[Column, Column, Column], ground: tuple[Column, Column, Column]) -> Column:
    """Polarity: whether text is drawn black."""
    lum = lambda c: 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
    lf, lb = lum(fill), lum(ground)
    return F.when(F.abs(lf - lb) > 20, lf < lb).otherwise(lf < 128)


def in_any_polygon(x: Column, y: Column, polygons: Column) -> Column:
    """Whether a point lies in one of an array of (ax, ay, ... dy) structs."""
    return F.exists(polygons, lambda q: inside((x, y), [(q[f"{c}x"], q[f"{c}y"]) for c in "abcd"]))


def ground_stats(pixels: DataFrame, key: str, r: Column, g: Column, b: Column) -> DataFrame:
    """(key, n, mean, std, red, green, blue) of the ground: luminance and whole-number mean colour; white below 16 pixels."""
    lum = 0.299 * r + 0.587 * g + 0.114 * b
    n = F.count(F.lit(1))
    rows = pixels.groupBy(key).agg(n.alias("n"), F.avg(lum).alias("mean"), F.stddev_pop(lum).alias("std"), *[F.floor(F.sum(c) / n).alias(k) for k, c in (("red", r), ("green", g), ("blue", b))])
    few = F.col("n") < 16
    return rows.select(key, "n", F.when(few, 255.0).otherwise(F.col("mean")).alias("mean"), F.when(few, 0.0).otherwise(F.col("std")).alias("std"), *[F.when(few, 255).otherwise(F.col(k)).alias(k) for k in ("red", "green", "blue")])


def simple_merge(gap: Column, font_a: Column, font_b: Column, same_direction: Column, most_ratio: float, most_gap: float) -> Column:
    """Whether two lines are one by distance alone: one direction, like font sizes, a gap below a share of the smaller font."""
    small = F.least(font_a, font_b)
    return same_direction & (small > 0) & (F.greatest(font_a, font_b) <= most_ratio * small) & (gap < small * most_gap)


def compare_outputs(outputs: DataFrame, expected: DataFrame, key: str, by: str) -> DataFrame:
    """(by, compared, mismatches, no_expect): outputs (key, by, sha) against expected (key, want); without a baseline nothing is compared."""
    rows = outputs.join(expected, key, "left")
    total = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy(by).agg(total(F.col("want").isNotNull()).alias("compared"), total(F.coalesce(F.col("want") != F.col("sha"), F.lit(False))).alias("mismatches"), total(F.col("want").isNull()).alias("no_expect"))


def to_resume(steps: DataFrame, state: DataFrame) -> DataFrame:
    """Steps that a resumed run still does: not done, not crashed, not interrupted twice. state: rows (step, what)."""
    count = lambda k: F.count_if(F.col("what") == k)
    over = state.groupBy("step").agg(((count("done") > 0) | (count("crashed") > 0) | (count("interrupted") > 1)).alias("over")).where("over")
    return steps.join(over, "step", "left_anti")
