"""Instance masks of segmentation models: what is left to compute once the network has given its maps.

A page is an image row (key, height, width, values) whose values are the maps, channels last, with an array of its instances. A worker
holds one page; each result is one boolean array a page, the union over the page's instances.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .images import _taps, map_images, resize_bilinear

#: Layers of the dynamic head, cells a feature is apart, scores and probabilities that count.
LAYERS = ((10, 8), (8, 8), (8, 1))
STEP = 8
LEAST_SCORE = 0.3
LEAST_PROBABILITY = 0.5


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Without overflow for any finite number."""
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, e) / (1.0 + e)


def layers(kernel: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of each layer: the parameters hold all weights, then all biases."""
    ends = np.cumsum([i * o for i, o in LAYERS] + [o for _, o in LAYERS])
    if len(kernel) != ends[-1]:
        raise ValueError(f"{len(kernel)} parameters, not {ends[-1]}")
    cut = np.split(kernel, ends[:-1])
    return [(w.reshape(o, i), b) for (i, o), w, b in zip(LAYERS, cut, cut[len(LAYERS) :], strict=False)]


def dynamic_mask(kernel: np.ndarray, features: np.ndarray, x: float, y: float, stride: int) -> np.ndarray:
    """Probabilities, STEP times the size of the features: each cell's offset from the instance and its features pass through the
    instance's own layers; the last one's output is scaled up before the sigmoid."""
    h, w = features.shape[:2]
    dy, dx = y - np.arange(h) * STEP, x - np.arange(w) * STEP
    near = np.stack(np.broadcast_arrays(dx[None, :], dy[:, None]), axis=-1) / (stride * 8.0)
    value = np.concatenate([near, features], axis=-1)
    for k, (weights, bias) in enumerate(layers(kernel)):
        value = value @ weights.T + bias
        if k < len(LAYERS) - 1:
            value = np.maximum(value, 0.0)
    return sigmoid(resize_bilinear(value[..., 0], h * STEP, w * STEP))


def to_page(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """The nearest cell at or before each page pixel."""
    nh, nw = mask.shape
    ys = np.minimum(np.floor(np.arange(height) * (nh / height)).astype(int), nh - 1)
    xs = np.minimum(np.floor(np.arange(width) * (nw / width)).astype(int), nw - 1)
    return mask[np.ix_(ys, xs)]


def spread(window: np.ndarray, at: tuple[int, int], shape: tuple[int, int], target: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """An image of a shape, zero but for a window at a place, scaled to a target size: the part that the window reaches, and its place."""
    place = []
    for axis in (0, 1):
        size = window.shape[axis]
        low, high, f = _taps(target[axis], shape[axis])
        low, high = low - at[axis], high - at[axis]
        reach = np.flatnonzero((low < size) & (high >= 0))
        place.append(int(reach[0]) if len(reach) else 0)
        total = 0.0
        for tap, share in ((low[reach], 1 - f[reach]), (high[reach], f[reach])):
            share = np.where((tap >= 0) & (tap < size), share, 0.0)
            total = total + window.take(np.clip(tap, 0, size - 1), axis) * (share[:, None] if axis == 0 else share)
        window = total
    return window, (place[0], place[1])


def prototype_part(prototypes: np.ndarray, coefficients: np.ndarray, box: tuple, size: int, inner: tuple, target: tuple) -> tuple[np.ndarray, tuple] | None:
    """Where an instance counts on the page: (boolean part, its place). None where its box holds no cell or lies in the padding.

    box is centre and size in the network's square of `size`; inner (top, left, height, width) is the page in it; target is the page's size.
    The mixed prototypes within the box are scaled to the square, the padding is cut off, and the rest is scaled to the page."""
    m = len(prototypes)
    (cx, cy, bw, bh), (top, left, ih, iw) = box, inner
    (x0, x1), (y0, y1) = ((max(0, math.floor((c - n / 2) * m / size)), min(m, math.ceil((c + n / 2) * m / size))) for c, n in ((cx, bw), (cy, bh)))
    if x1 <= x0 or y1 <= y0:
        return None
    part, (y, x) = spread(sigmoid(prototypes[y0:y1, x0:x1] @ coefficients), (y0, x0), (m, m), (size, size))
    part = part[max(0, top - y) : max(0, top + ih - y), max(0, left - x) : max(0, left + iw - x)]
    if not part.size:
        return None
    part, place = spread(part, (max(y, top) - top, max(x, left) - left), (ih, iw), target)
    return part > LEAST_PROBABILITY, place


def dynamic_masks(pages: DataFrame, least_score: float = LEAST_SCORE, least: float = LEAST_PROBABILITY) -> DataFrame:
    """(page, mask) of pages (page, height, width, values: features, inner_h, inner_w, page_h, page_w, instances).

    An instance is (x, y, stride, score, kernel); those above least_score count. The corner inner_h x inner_w of the union is the page,
    scaled to page_h x page_w. A page without instances has an empty mask; null instances count as none."""

    def union(v, r):
        on = np.zeros((r["height"] * STEP, r["width"] * STEP), bool)
        for i in r["instances"] or ():
            if i["score"] > least_score:
                on |= dynamic_mask(np.array(i["kernel"], float), v, i["x"], i["y"], i["stride"]) > least
        yield (to_page(on[: r["inner_h"], : r["inner_w"]], r["page_h"], r["page_w"]).ravel(),)

    return map_images(pages, union, "mask array<boolean>", ["page"])


def prototype_masks(pages: DataFrame, size: int) -> DataFrame:
    """(page, mask) of pages (page, height, width, values: prototypes, top, left, inner_h, inner_w, page_h, page_w, instances).

    An instance is (cx, cy, w, h, coefficients). Instances whose box holds no prototype cell are skipped; null instances count as none."""

    def union(v, r):
        on = np.zeros((r["page_h"], r["page_w"]), bool)
        for i in r["instances"] or ():
            inner = r["top"], r["left"], r["inner_h"], r["inner_w"]
            found = prototype_part(v, np.array(i["coefficients"], float), (i["cx"], i["cy"], i["w"], i["h"]), size, inner, on.shape)
            if found:
                part, (y, x) = found
                on[y : y + part.shape[0], x : x + part.shape[1]] |= part
        yield (on.ravel(),)

    return map_images(pages, union, "mask array<boolean>", ["page"])
