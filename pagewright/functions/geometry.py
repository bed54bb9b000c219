"""Plane geometry as Column expressions over corner coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two corner boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h + F.lit(1e-9))


def shoelace(points: list[Point]) -> Column:
    """Area of a polygon."""
    terms = [x * v - u * y for (x, y), (u, v) in zip(points, [*points[1:], points[0]], strict=True)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.abs(total) / 2


def segment_distance(p: Point, a: Point, b: Point) -> Column:
    """Distance of p from the segment a-b; a segment without length counts as its start."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.when(n > 0, n)))).otherwise(F.lit(0.0))
    return F.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def turn(a: Point, b: Point, c: Point) -> Column:
    """Side of c as seen along a-b: -1, 0 or 1, with a dead band of 1e-6."""
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return F.when(v > 1e-6, 1).when(v < -1e-6, -1).otherwise(0)


def crosses(a: Point, b: Point, c: Point, d: Point) -> Column:
    return (turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b))


def inside(p: Point, polygon: list[Point]) -> Column:
    """Ray casting."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        spans = (y1 > p[1]) != (y2 > p[1])
        at = (x2 - x1) * (p[1] - y1) / F.when(y2 != y1, y2 - y1) + x1
        out = out != (spans & (p[0] < F.coalesce(at, F.lit(0.0))))
    return out


def polygon_distance(a: list[Point], b: list[Point]) -> Column:
    """0 if edges cross or a first corner lies inside the other, else the least distance of a corner from an edge."""
    edges = lambda q: list(zip(q, [*q[1:], q[0]], strict=True))
    meet = inside(a[0], b) | inside(b[0], a)
    for p, q in edges(a):
        for r, s in edges(b):
            meet = meet | crosses(p, q, r, s)
    near = [segment_distance(p, *e) for p in a for e in edges(b)] + [segment_distance(p, *e) for p in b for e in edges(a)]
    return F.when(meet, F.lit(0.0)).otherwise(F.least(*near))


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of two upright boxes."""
    dx = F.greatest(F.lit(0.0), b["x1"] - a["x2"], a["x1"] - b["x2"])
    dy = F.greatest(F.lit(0.0), b["y1"] - a["y2"], a["y1"] - b["y2"])
    return F.sqrt(dx * dx + dy * dy)


def columns(prefix: str = "", names: str = "x1 y1 x2 y2") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in names.split()}


def corners(prefix: str = "") -> list[Point]:
    """The points (ax, ay) to (dx, dy)."""
    return [(F.col(f"{prefix}{c}x"), F.col(f"{prefix}{c}y")) for c in "abcd"]


def box_corners(r: dict[str, Column]) -> list[Point]:
    return [(r["x1"], r["y1"]), (r["x2"], r["y1"]), (r["x2"], r["y2"]), (r["x1"], r["y2"])]
