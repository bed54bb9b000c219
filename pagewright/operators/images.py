"""Whole page images in numpy, one page at a time in Arrow batches: detector maps to lines and masks, letterboxes, strips.

An image is a row (key, height, width, values): values is the array of its numbers, row by row, channels last. A worker holds one
page and its results; configuration is an argument of each call, never a global.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .grouping import min_area_rect


@dataclass(frozen=True)
class DetectorConfig:
    """The defaults."""

    min_side: float = 3.0
    mask_threshold: float = 0.12
    bin_threshold: float = 0.5
    box_threshold: float = 0.7
    unclip_ratio: float = 2.3


def map_images(images: DataFrame, fn: Callable, schema: str, keep: list[str]) -> DataFrame:
    """Rows fn(image, row) of each image row, with the kept columns in front. fn gets values as an array of shape (height, width, ...)."""
    extra = StructType.fromDDL(schema)
    out = StructType([images.schema[k] for k in keep] + extra.fields)

    def run(batches):
        for b in batches:
            for row in (b.slice(i, 1) for i in range(b.num_rows)):
                r = {n: row.column(n)[0].as_py() for n in row.schema.names if n != "values"}
                v = row.column("values")[0].values.to_numpy(zero_copy_only=False)
                found = [[r[k] for k in keep] + list(x) for x in fn(v.reshape(r["height"], r["width"], -1).squeeze(-1) if v.size == r["height"] * r["width"] else v.reshape(r["height"], r["width"], -1), r)]
                if found:
                    types = b.schema
                    cols = [pa.array([x[i] for x in found], types.field(k).type) if i < len(keep) else pa.array([x[i] for x in found]) for i, k in enumerate([*keep, *extra.names])]
                    yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return images.mapInArrow(run, out)


def labels8(on: np.ndarray) -> np.ndarray:
    """8-connected components of a boolean image: the least place of each, -1 off."""
    h, w = on.shape
    out = np.full((h, w), -1, np.int64)
    for y, x in zip(*np.nonzero(on), strict=True):
        if out[y, x] >= 0:
            continue
        name = y * w + x
        out[y, x], todo = name, [(y, x)]
        while todo:
            j, i = todo.pop()
            ys, xs = slice(max(0, j - 1), j + 2), slice(max(0, i - 1), i + 2)
            for dj, di in np.argwhere(on[ys, xs] & (out[ys, xs] < 0)).tolist():
                p = ys.start + dj, xs.start + di
                out[p] = name
                todo.append(p)
    return out


def text_lines(prob: np.ndarray, ratio: float, width: int, height: int, config: DetectorConfig) -> list[tuple[list[float], float]]:
    """(eight corner coordinates on the page, score) of the text lines of a probability map.

    A line is a component above bin_threshold whose mean probability reaches box_threshold; its box is the smallest rectangle around the
    component's edge (cells with a side neighbour outside), at least min_side, grown by area * unclip_ratio / perimeter on each side."""
    on = prob > config.bin_threshold
    padded = np.pad(on, 1)
    edge = on & ~(padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:])
    label = labels8(on)
    out = []
    for name in np.unique(label[on]).tolist():
        own = label == name
        score = float(prob[own].mean(dtype=np.float64))
        ys, xs = np.nonzero(own & edge)
        rect = min_area_rect(list(zip(xs.tolist(), ys.tolist(), strict=True)))
        if score < config.box_threshold or rect is None or min(rect[4:]) < config.min_side:
            continue
        cx, cy, ux, uy, w, h = rect
        grow = 2 * w * h * config.unclip_ratio / (2 * (w + h)) if w + h > 5e-7 else 0.0
        w, h = w + grow, h + grow
        corners = [(cx + (i * w * ux - j * h * uy) / 2, cy + (i * w * uy + j * h * ux) / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        out.append(([c for x, y in corners for c in (min(max(x / ratio, 0.0), float(width)), min(max(y / ratio, 0.0), float(height)))], score))
    return out


def detect_lines(maps: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(page, quad, score) of maps (page, height, width, values: logits, ratio, page_w, page_h)."""
    with np.errstate(over="ignore"):
        return map_images(maps, lambda v, r: text_lines(1 / (1 + np.exp(-v.astype(np.float64))), r["ratio"], r["page_w"], r["page_h"], config), "quad array<double>, score double", ["page"])


def _taps(dst: int, src: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = np.clip((np.arange(dst) + 0.5) * (src / dst) - 0.5, 0, src - 1)
    low = np.floor(pos).astype(int)
    return low, np.minimum(low + 1, src - 1), pos - low


def resize_bilinear(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Half-pixel centres, kept within the image."""
    a, b, f = _taps(height, img.shape[0])
    c, d, g = _taps(width, img.shape[1])
    f = f.reshape(-1, *[1] * (img.ndim - 1))
    g = g.reshape(1, -1, *[1] * (img.ndim - 2))
    rows = img[a] * (1 - f) + img[b] * f
    return rows[:, c] * (1 - g) + rows[:, d] * g


def resize_area(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the covered source area: one matrix of shares for each axis."""

    def shares(dst, src):
        edge = np.arange(dst + 1) * (src / dst)
        cell = np.arange(src)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None) / (src / dst)

    return np.einsum("ys,xt,st...->yx...", shares(height, img.shape[0]), shares(width, img.shape[1]), img, optimize=True)


def page_mask(seg: np.ndarray, ratio: float, width: int, height: int, threshold: float = DetectorConfig.mask_threshold) -> np.ndarray:
    """Mask of a page: the valid corner of a segmentation map in whole 255ths, scaled up, above the threshold in whole 255ths."""
    nh = min(max(math.floor(height * ratio + 0.5), 1), seg.shape[0])
    nw = min(max(math.floor(width * ratio + 0.5), 1), seg.shape[1])
    grey = np.clip(np.trunc(seg[:nh, :nw] * 255), 0, 255)
    return np.floor(resize_bilinear(grey, height, width) + 0.5) > math.trunc(threshold * 255)


def letterbox_corner(img: np.ndarray, size: int, mean, std, pad: float) -> tuple[np.ndarray, int, int]:
    """(3 x size x size, height, width): an RGB page in the top left corner, by area, whole numbers, BGR, less mean over std."""
    h, w = img.shape[:2]
    nh, nw = (math.floor(x * (size / max(w, h)) + 0.5) for x in (h, w))
    out = np.full((size, size, 3), float(pad))
    out[:nh, :nw] = np.clip(np.floor(resize_area(img[..., ::-1].astype(np.float64), nh, nw) + 0.5), 0, 255)
    return ((out - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1), nh, nw


def letterbox_centre(img: np.ndarray, size: int, pad: float) -> tuple[np.ndarray, int, int, int, int]:
    """(3 x size x size, height, width, top, left): an RGB page in the middle, bilinear, whole numbers, over 255."""
    h, w = img.shape[:2]
    r = min(size / h, size / w)
    nh, nw = math.floor(h * r + 0.5), math.floor(w * r + 0.5)
    top, left = (size - nh) // 2, (size - nw) // 2
    out = np.full((size, size, 3), float(pad))
    out[top : top + nh, left : left + nw] = np.clip(np.trunc(resize_bilinear(img.astype(np.float64), nh, nw) + 0.5), 0, 255)
    return (out / 255).transpose(2, 0, 1), nh, nw, top, left


def homography(src: list, dst: list) -> np.ndarray:
    """The 3 x 3 matrix that takes four points dst to src."""
    rows = [r for (x, y), (u, v) in zip(dst, src, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(src, float).ravel()), 1.0).reshape(3, 3)


def cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    x = np.abs(t)
    return np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a, 0.0))


def warp_strip(img: np.ndarray, quad: list, width: int, height: int) -> np.ndarray:
    """The quadrilateral of a page as a strip of width x height, by 4 x 4 cubic taps within the page, as whole numbers."""
    m = homography(quad, [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)])
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, z = (m @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])).reshape(3, height, width)
    sx, sy = u / z, v / z
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = 0.0
    for j in range(-1, 3):
        for i in range(-1, 3):
            w = cubic(sx - (fx + i)) * cubic(sy - (fy + j))
            tap = img[np.clip(fy + j, 0, img.shape[0] - 1), np.clip(fx + i, 0, img.shape[1] - 1)]
            out = out + (w[..., None] if img.ndim == 3 else w) * tap
    return np.clip(np.floor(out + 0.5), 0, 255)


def cut_strips(images: DataFrame, height: int = 48) -> DataFrame:
    """(page, line, height, width, values) of images (page, height, width, values, quads): a strip for each quadrilateral, upright lines
    turned a quarter counter-clockwise. A quadrilateral without extent has none."""

    def strips(img, r):
        for k, q in enumerate(r["quads"]):
            p = [(q[i], q[i + 1]) for i in range(0, 8, 2)]
            across = math.hypot((p[1][0] + p[2][0] - p[0][0] - p[3][0]) / 2, (p[1][1] + p[2][1] - p[0][1] - p[3][1]) / 2)
            down = math.hypot((p[2][0] + p[3][0] - p[0][0] - p[1][0]) / 2, (p[2][1] + p[3][1] - p[0][1] - p[1][1]) / 2)
            if min(across, down) < 1:
                continue
            if down > across:
                s = np.rot90(warp_strip(img, p, height, max(2, math.floor(height * down / across + 0.5))))
            else:
                s = warp_strip(img, p, max(2, math.floor(height * across / down + 0.5)), height)
            yield k, s.shape[0], s.shape[1], s.ravel().astype(np.int32).tolist()

    return map_images(images, strips, "line long, height long, width long, values array<long>", ["page"])


def match_boxes(a: list, b: list, least: float = 0.7) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b): each box of a, in order, takes the free box of b that it overlaps most, from `least` IoU on."""
    free, out = set(range(len(b))), []
    for i, p in enumerate(a):
        best, at = 0.0, -1
        for j in sorted(free):
            q = b[j]
            both = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
            either = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both
            if either > 0 and both / either > best:
                best, at = both / either, j
        if best >= least:
            out.append((i, at))
            free.discard(at)
    return out
