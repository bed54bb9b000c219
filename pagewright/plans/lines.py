"""Queries over recogniser output, boxes, quadrilaterals and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grouping as R
from ..operators import sequence as S
from ..sources.tables import BOXES, QUADS, STEPS, as_sql, bind, table

B, Q, ST = as_sql(BOXES), as_sql(QUADS), as_sql(STEPS)
ALPHABET = [(1, "a"), (2, "b"), (3, " "), (4, "c")]
_ALPHA = "(VALUES (1, 'a'), (2, 'b'), (3, ' '), (4, 'c')) AS a(idx, symbol)"
_EMIT = f"(SELECT strip, t, event_id, idx, logp FROM (SELECT *, lag(idx, 1, 0) OVER (PARTITION BY strip ORDER BY t, event_id) AS b FROM {ST}) WHERE idx <> 0 AND idx <> b)"
_TEXT = f"(SELECT s.strip, coalesce(string_agg(a.symbol, '' ORDER BY e.t, e.event_id), '') AS text, coalesce(exp(avg(e.logp)), 0) AS prob FROM (SELECT DISTINCT strip FROM {ST}) s LEFT JOIN {_EMIT} e ON e.strip = s.strip LEFT JOIN {_ALPHA} ON a.idx = e.idx GROUP BY s.strip)"


def _iou(a, b):
    w, h = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))", f"greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    return f"({w} * {h} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {w} * {h} + 1e-9))"


def _nms_sql(threshold):
    """The greedy loop as recursion over ranks."""
    return f"""
        WITH RECURSIVE s AS (
            SELECT page, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, id) AS b FROM {B} GROUP BY page),
        r(page, b, n, kept) AS (
            SELECT page, b, 0, [b[1]] FROM s
            UNION ALL
            SELECT page, b, n + 1, CASE WHEN len(list_filter(kept, lambda k: {_iou('k', 'b[n + 2]')} > {threshold})) > 0 THEN kept ELSE list_append(kept, b[n + 2]) END
            FROM r WHERE n + 1 < len(b))
        SELECT page, unnest(kept).id AS id FROM r WHERE n + 1 = len(b)"""


def _boxes(s, d):
    return bind(s, d, BOXES)


def _quads(s, d):
    return bind(s, d, QUADS)


def _pairs(s, d):
    """Pairs of boxes of a page: an equi-join on the page, so no nested loops; a page has tens of boxes."""
    b = _boxes(s, d)
    a = b.select("page", *[F.col(c).alias("a_" + c) for c in b.columns if c != "page"])
    c = b.select("page", *[F.col(c).alias("b_" + c) for c in b.columns if c != "page"])
    return a.join(c, "page").where("a_id < b_id")


def _quad_pairs(s, d):
    q = _quads(s, d)
    a = q.select("page", *[F.col(c).alias("a_" + c) for c in q.columns if c != "page"])
    c = q.select("page", *[F.col(c).alias("b_" + c) for c in q.columns if c != "page"])
    return a.join(c, "page").where("a_id < b_id")


def _steps(s, d):
    return bind(s, d, STEPS)


def _text(s, d):
    return S.ctc_text(_steps(s, d), s.createDataFrame(ALPHABET, "idx int, symbol string"), order=("t", "event_id"))


def _merge(s, d):
    """Upright boxes that may merge, as grouping.may_merge has it: near for their size, sizes and shapes alike, centres or edges in line."""
    a, b = G.columns("a_"), G.columns("b_")
    wa, ha, wb, hb = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    fa, fb = F.least(wa, ha), F.least(wb, hb)
    c = F.least(fa, fb)
    centre = F.abs(a["x1"] + a["x2"] - b["x1"] - b["x2"]) < 6
    aspect = lambda w, h: F.when(h > 0, w / h).otherwise(1.0)
    ra, rb = aspect(wa, ha), aspect(wb, hb)
    unlike = ((ra > 1.3) & (rb < 1 / 1.3)) | ((rb > 1.3) & (ra < 1 / 1.3))
    wide_a, wide_b, tall_a, tall_b = wa > ha * 1.9, wb > hb * 1.9, ha > wa * 1.9, hb > wb * 1.9
    near = lambda *edges: (F.abs(a[edges[0]] - b[edges[0]]) < 3 * c) | (F.abs(a[edges[1]] - b[edges[1]]) < 3 * c)
    aligned = F.when((wide_a & tall_b) | (wide_b & tall_a), False).when(wide_a | wide_b, near("x1", "x2")).when(tall_a | tall_b, near("y1", "y2")).otherwise(False)
    return _pairs(s, d).where((G.box_gap(a, b) < c) & (F.greatest(fa, fb) <= 2 * c) & ~unlike & (centre | aligned)).select("page", "a_id", "b_id")


_PAIRS = f"(SELECT a.page, a.id AS a_id, b.id AS b_id, a AS a, b AS b FROM {B} a JOIN {B} b ON a.page = b.page AND a.id < b.id)"
_GAP = "sqrt(power(greatest(0.0, b.x1 - a.x2, a.x1 - b.x2), 2) + power(greatest(0.0, b.y1 - a.y2, a.y1 - b.y2), 2))"
_SIDES = "SELECT page, a_id, b_id, a, b, a.x2 - a.x1 AS wa, a.y2 - a.y1 AS ha, b.x2 - b.x1 AS wb, b.y2 - b.y1 AS hb, least(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1) AS c FROM " + _PAIRS
_MERGE = f"""(SELECT page, a_id, b_id FROM ({_SIDES}) WHERE {_GAP} < c AND greatest(least(wa, ha), least(wb, hb)) <= 2 * c
    AND NOT (wa > 1.3 * ha AND wb * 1.3 < hb OR wb > 1.3 * hb AND wa * 1.3 < ha)
    AND (abs(a.x1 + a.x2 - b.x1 - b.x2) < 6 OR CASE
        WHEN wa > ha * 1.9 AND hb > wb * 1.9 OR wb > hb * 1.9 AND ha > wa * 1.9 THEN false
        WHEN wa > ha * 1.9 OR wb > hb * 1.9 THEN abs(a.x1 - b.x1) < 3 * c OR abs(a.x2 - b.x2) < 3 * c
        WHEN ha > wa * 1.9 OR hb > wb * 1.9 THEN abs(a.y1 - b.y1) < 3 * c OR abs(a.y2 - b.y2) < 3 * c
        ELSE false END))"""


def edge_components(s, d):
    nodes = _boxes(s, d).select("page", "id", F.lit(None).cast("bigint").alias("other"))
    rows = nodes.unionByName(_merge(s, d).select("page", F.col("a_id").alias("id"), F.col("b_id").alias("other")))

    def page(number, rows):
        ids = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(ids)}
        return [(number, ids[m], ids[min(c)]) for c in R.components(len(ids), [(at[a], at[b]) for a, b in rows if b is not None]) for m in c]

    return R.map_pages(rows, ["id"], page, "page long, id long, region_id long")


_COMPONENTS = f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT page, a_id AS a, b_id AS b FROM {_MERGE} UNION ALL SELECT page, b_id, a_id FROM {_MERGE}),
    r(page, id, root) AS (SELECT page, id, id FROM {B} UNION SELECT r.page, r.id, e.b FROM r JOIN e ON e.page = r.page AND e.a = r.root)
    SELECT page, id, min(root) AS region_id FROM r GROUP BY page, id"""
_POINTS = "(SELECT page, id, unnest([{'x': ax, 'y': ay}, {'x': bx, 'y': q.by}, {'x': cx, 'y': cy}, {'x': dx, 'y': dy}]) AS p FROM " + Q + " q)"


def _points(s, d):
    return _quads(s, d).select("page", "id", F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in G.corners()])).alias("p")).select("page", "id", "p.x", "p.y")


def _direction(s, d):
    b = _boxes(s, d)
    ratio = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    rows = b.select("page", "id", F.when(ratio > 1, "v").otherwise("h").alias("dir"), F.greatest(ratio, 1 / ratio).alias("extreme"))
    votes = rows.groupBy("page").agg(F.sum((F.col("dir") == "v").cast("int")).alias("v"), F.sum((F.col("dir") == "h").cast("int")).alias("h"), F.max_by("dir", F.struct("extreme", -F.col("id"))).alias("tie"))
    return votes.select("page", F.when(F.col("v") > F.col("h"), "v").when(F.col("h") > F.col("v"), "h").otherwise(F.col("tie")).alias("direction"))


def _reading(s, d):
    b = _boxes(s, d).join(_direction(s, d), "page")
    key = F.when(F.col("direction") == "h", F.col("y1") + F.col("y2")).otherwise(-(F.col("x1") + F.col("x2")))
    return b.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "id"))), lambda x: x["id"].cast("string")), ",").alias("line_ids"))


_DIR = f"(SELECT page, CASE WHEN count(*) FILTER (r > 1) > count(*) FILTER (r <= 1) THEN 'v' WHEN count(*) FILTER (r > 1) < count(*) FILTER (r <= 1) THEN 'h' ELSE arg_max(CASE WHEN r > 1 THEN 'v' ELSE 'h' END, (greatest(r, 1 / r), -id)) END AS direction FROM (SELECT *, (y2 - y1) / (x2 - x1) AS r FROM {B}) GROUP BY page)"


def _oriented(s, d):
    p = _points(s, d)
    rad = F.radians((F.col("page") % 40 - 20).cast("double"))
    mean = p.groupBy("page").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    q = p.join(mean, "page").select("page", "cx", "cy", (F.cos(rad) * (F.col("x") - F.col("cx")) + F.sin(rad) * (F.col("y") - F.col("cy"))).alias("u"), (F.cos(rad) * (F.col("y") - F.col("cy")) - F.sin(rad) * (F.col("x") - F.col("cx"))).alias("v"))
    return q.groupBy("page").agg(F.round(F.max("u") - F.min("u"), 6).alias("box_w"), F.round(F.max("v") - F.min("v"), 6).alias("box_h"))


def _unclip(s, d):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    e = w * h * 2.3 / (2 * (w + h))
    return _boxes(s, d).where((F.least(w, h) >= 7) & (F.col("score") >= 700)).select("page", "id", F.round(w + 2 * e, 6).alias("w"), F.round(h + 2 * e, 6).alias("h"))


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _anchors(s, d):
    cells = _vectors(s, d).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(*[F.get("e", i * 4 + k).alias(n) for k, n in enumerate("ltrb")]))).alias("idx", "c")).select("vec_id", "idx", "c.*")
    out = S.anchor_decode(cells, 8, 32, 4)
    return out.select("vec_id", "idx", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _poly_distance(s, d):
    a, b = G.corners("a_"), G.corners("b_")
    return _quad_pairs(s, d).select("page", "a_id", "b_id", F.round(G.polygon_distance(a, b), 6).alias("distance"))


def _seg_sql(px, py, ax, ay, bx, by):
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    n = f"({dx} * {dx} + {dy} * {dy})"
    t = f"CASE WHEN {n} > 0 THEN greatest(0.0, least(1.0, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / nullif({n}, 0))) ELSE 0.0 END"
    return f"sqrt(power({px} - {ax} - ({t}) * {dx}, 2) + power({py} - {ay} - ({t}) * {dy}, 2))"


def _poly_sql():
    pts = {k: [(f"{k}.{c}x", f"{k}.{c}y") for c in "abcd"] for k in ("p", "q")}
    turn = lambda a, b, c: f"CASE WHEN ({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}) > 1e-6 THEN 1 WHEN ({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}) < -1e-6 THEN -1 ELSE 0 END"
    edges = lambda q: list(zip(q, [*q[1:], q[0]], strict=True))
    meet = [f"({turn(a, b, c)}) <> ({turn(a, b, e)}) AND ({turn(c, e, a)}) <> ({turn(c, e, b)})" for a, b in edges(pts["p"]) for c, e in edges(pts["q"])]

    def inside(p, poly):
        hits = [f"CASE WHEN ({y1} > {p[1]}) <> ({y2} > {p[1]}) AND {p[0]} < ({x2} - {x1}) * ({p[1]} - {y1}) / nullif({y2} - {y1}, 0) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(poly, [poly[-1], *poly[:-1]], strict=True)]
        return f"({' + '.join(hits)}) % 2 = 1"

    near = [_seg_sql(*p, *a, *b) for x, y in (("p", "q"), ("q", "p")) for p in pts[x] for a, b in edges(pts[y])]
    cond = " OR ".join(f"({m})" for m in [*meet, inside(pts["p"][0], pts["q"]), inside(pts["q"][0], pts["p"])])
    return f"SELECT p.page, p.id AS a_id, q.id AS b_id, round(CASE WHEN {cond} THEN 0.0 ELSE least({', '.join(near)}) END, 6) AS distance FROM {Q} p JOIN {Q} q ON p.page = q.page AND p.id < q.id"


def _quad_features(s, d):
    def number(q):
        x = R.Line(q)
        return (x.down, round(x.font, 6), round(x.aspect, 6), round(x.angle, 6), round(x.cx, 6), round(x.cy, 6), x.upright)

    return R.grouped_numbers(_quads(s, d), number, "page long, id long, down boolean, font double, aspect double, angle double, cx double, cy double, upright boolean")


def _rows_of(fn, schema):
    return lambda s, d: R.grouped_numbers(_quads(s, d), fn, schema)


_CELLS = "(SELECT vec_id, unnest(range(0, 16)) AS idx, embedding FROM embeddings)"
_CL = lambda e: f"round(greatest(0.0, least(32.0, {e})), 6)"
_DIST = lambda k: f"greatest(0.0, embedding[idx * 4 + {k}]::DOUBLE) * 8"

_DIFF = lambda i, j, a: f"({'abcd'[i]}{a} - {'abcd'[j]}{a})"
#: Corners in order: the third and fourth shortest of the pairwise vectors, each of which occurs twice after the four empty ones.
_ORDERED = f"""(SELECT page, id, down, CASE WHEN down THEN [n0, n1, f1, f0] ELSE [n0, f0, f1, n1] END AS p FROM (
    SELECT page, id, down, CASE WHEN down AND s[2].x < s[1].x OR NOT down AND s[2].y < s[1].y THEN s[2] ELSE s[1] END AS n0, CASE WHEN down AND s[2].x < s[1].x OR NOT down AND s[2].y < s[1].y THEN s[1] ELSE s[2] END AS n1,
           CASE WHEN down AND s[4].x < s[3].x OR NOT down AND s[4].y < s[3].y THEN s[4] ELSE s[3] END AS f0, CASE WHEN down AND s[4].x < s[3].x OR NOT down AND s[4].y < s[3].y THEN s[3] ELSE s[4] END AS f1
    FROM (SELECT page, id, down, list_sort([{", ".join(f"{{'k': CASE WHEN down THEN {c}y ELSE {c}x END, 'i': {i}, 'x': {c}x, 'y': {c}y}}" for i, c in enumerate("abcd"))}]) AS s FROM (
        SELECT *, CASE WHEN v[9].x * v[11].x + v[9].y * v[11].y < 0 THEN abs(v[11].x - v[9].x) <= abs(v[11].y - v[9].y) ELSE abs(v[11].x + v[9].x) <= abs(v[11].y + v[9].y) END AS down
        FROM (SELECT *, list_sort([{", ".join(f"{{'d': {_DIFF(i, j, 'x')} * {_DIFF(i, j, 'x')} + {_DIFF(i, j, 'y')} * {_DIFF(i, j, 'y')}, 'k': {4 * i + j}, 'x': {_DIFF(i, j, 'x')}, 'y': {_DIFF(i, j, 'y')}}}" for i in range(4) for j in range(4))}]) AS v
            FROM (SELECT page, id, ax, ay, bx, q.by AS by_, cx, cy, dx, dy FROM {Q} q))))))""".replace("by -", "by_ -").replace("- by)", "- by_)").replace("THEN by ELSE", "THEN by_ ELSE").replace("'y': by}", "'y': by_}")
_HALF = lambda a, b, c: f"trunc((p[{a}].{c} + p[{b}].{c}) / 2)"
_FEATURES = f"""(SELECT page, id, down, p, vx, vy, hx, hy, sqrt(vx * vx + vy * vy) AS nv, sqrt(hx * hx + hy * hy) AS nh FROM (
    SELECT page, id, down, p, {_HALF(3, 4, 'x')} - {_HALF(1, 2, 'x')} AS vx, {_HALF(3, 4, 'y')} - {_HALF(1, 2, 'y')} AS vy, {_HALF(4, 1, 'x')} - {_HALF(2, 3, 'x')} AS hx, {_HALF(4, 1, 'y')} - {_HALF(2, 3, 'y')} AS hy FROM {_ORDERED}))"""

QUERIES = {
    "ctc_collapse": lambda s, d: S.ctc_collapse(_steps(s, d), order=("t", "event_id")).select("strip", "event_id", "idx"),
    "ctc_text_prob": lambda s, d: _text(s, d).select("strip", "text", F.round("prob", 6).alias("prob")),
    "ctc_confidence_filter": lambda s, d: _text(s, d).select("strip", F.when((F.round("prob", 6) >= 0.6) & (F.length("text") >= 1), F.col("text")).otherwise("").alias("text")),
    "logsoftmax_top1": lambda s, d: S.log_softmax_top1(table(s, d, "embeddings"), "embedding", "vec_id").withColumn("logp", F.round("logp", 6)),
    "sigmoid_threshold": lambda s, d: _vectors(s, d).select("vec_id", F.size(F.filter("e", lambda x: S.sigmoid(x) > 0.53)).cast("bigint").alias("n_over"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + S.sigmoid(x)) / F.size("e"), 6).alias("mean_prob")),
    "pos_encoding": lambda s, d: S.position_table(s, 33, 320).withColumn("value", F.round("value", 5)),
    "nms_corner": lambda s, d: S.nms(_boxes(s, d), "page", 0.3, limit=100),
    "nms_centre": lambda s, d: S.nms(_boxes(s, d).selectExpr("page", "id", "score", "(x1 + x2) / 2 AS cx", "(y1 + y2) / 2 AS cy", "x2 - x1 AS w", "y2 - y1 AS h").selectExpr("page", "id", "score", "cx - w / 2 AS x1", "cy - h / 2 AS y1", "cx + w / 2 AS x2", "cy + h / 2 AS y2"), "page", 0.15),
    "iou_join": lambda s, d: _pairs(s, d).withColumn("iou", F.round(G.iou(G.columns("a_"), G.columns("b_")), 6)).where("iou > 0.1").select("page", "a_id", "b_id", "iou"),
    "anchor_decode": _anchors,
    "merge_edges_aabb": _merge,
    "edge_components": edge_components,
    "region_aabb": lambda s, d: edge_components(s, d).join(_boxes(s, d), ["page", "id"]).groupBy("page", "region_id").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x2").alias("x1"), F.max("y2").alias("y1"), F.count(F.lit(1)).alias("n_lines")),
    "region_angle": lambda s, d: _boxes(s, d).groupBy("page").agg(F.round(F.degrees(F.avg(F.acos(F.lit(0.0)) + (F.col("id") % 9 - 4) / 40.0)) - 90, 6).alias("a")).select("page", F.when(F.abs("a") < 3, 0.0).otherwise(F.col("a")).alias("angle")),
    "oriented_box": _oriented,
    "majority_direction": _direction,
    "reading_order": _reading,
    "poly_area": lambda s, d: _quads(s, d).select("page", "id", F.round(G.shoelace(G.corners()), 6).alias("area")),
    "seg_point_distance": lambda s, d: _quads(s, d).select("page", "id", F.round(G.segment_distance((F.col("cx"), F.col("cy")), *G.corners()[:2]), 6).alias("distance")),
    "poly_distance": _poly_distance,
    "unclip": _unclip,
    "scaled_clamped": lambda s, d: _boxes(s, d).select("page", "id", *[F.greatest(F.lit(0.0), F.least(F.lit(64.0), F.col(c) / 1.6)).alias(c) for c in ("x1", "y1", "x2", "y2")]),
    "strip_size": lambda s, d: _boxes(s, d).select("page", "id", F.greatest(F.lit(2), F.floor(48 * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + 0.5).cast("int")).alias("w")).withColumn("t", F.expr("w div 4 - 1")),
    "quad_order": _rows_of(lambda q: (lambda p, v: (v, *[c for x in p for c in x]))(*R.order_quad(q)), "page long, id long, down boolean, " + ", ".join(f"{a}{i} double" for i in range(4) for a in "xy")),
    "quad_features": _quad_features,
    "convex_hull": _rows_of(lambda q: (len(R.hull(q)), R.area(R.hull(q))), "page long, id long, n_points long, area double"),
    "min_area_rect": _rows_of(lambda q: (lambda r: (round(r[4], 6), round(r[5], 6)))(R.min_area_rect(q)), "page long, id long, w double, h double"),
    "mst_split": lambda s, d: R.group_lines(_quads(s, d)).select("page", "region_id", F.size("line_ids").alias("n_lines")),
    "grouping_full": lambda s, d: R.group_lines(_quads(s, d)),
}
ORACLES = {
    "quad_order": f"SELECT page, id, down, {', '.join(f'p[{i + 1}].{a} AS {a}{i}' for i in range(4) for a in 'xy')} FROM {_ORDERED}",
    "quad_features": f"""SELECT page, id, down, round(least(nv, nh), 6) AS font, round(CASE WHEN nv > 0 THEN nh / nv ELSE 1.0 END, 6) AS aspect,
        round(CASE WHEN nv > 0 THEN (acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, vx / nv))) + pi()) % pi() ELSE pi() / 2 END, 6) AS angle,
        round((p[1].x + p[2].x + p[3].x + p[4].x) / 4, 6) AS cx, round((p[1].y + p[2].y + p[3].y + p[4].y) / 4, 6) AS cy,
        abs(CASE WHEN nv > 0 THEN vx / nv ELSE 0 END) < 0.05 OR abs(CASE WHEN nv > 0 THEN vy / nv ELSE 0 END) < 0.05 OR abs(CASE WHEN nh > 0 THEN hx / nh ELSE 0 END) < 0.05 OR abs(CASE WHEN nh > 0 THEN hy / nh ELSE 0 END) < 0.05 AS upright
        FROM {_FEATURES}""",
    "ctc_collapse": f"SELECT strip, event_id, idx FROM {_EMIT}",
    "ctc_text_prob": f"SELECT strip, text, round(prob, 6) AS prob FROM {_TEXT}",
    "ctc_confidence_filter": f"SELECT strip, CASE WHEN round(prob, 6) >= 0.6 AND length(text) >= 1 THEN text ELSE '' END AS text FROM {_TEXT}",
    "logsoftmax_top1": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS top, round(-ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))), 6) AS logp FROM embeddings",
    "sigmoid_threshold": "SELECT vec_id, len(list_filter(embedding, lambda x: 1 / (1 + exp(-(x::DOUBLE))) > 0.53))::BIGINT AS n_over, round(list_sum(list_transform(embedding, lambda x: 1 / (1 + exp(-(x::DOUBLE))))) / len(embedding), 6) AS mean_prob FROM embeddings",
    "pos_encoding": "SELECT (n // 320)::INT AS t, (n % 320)::INT AS d, round(CASE WHEN n % 2 = 0 THEN sin((n // 320) * exp((n % 320) * (-ln(10000.0) / 320))) ELSE cos((n // 320) * exp((n % 320 - 1) * (-ln(10000.0) / 320))) END, 5) AS value FROM range(0, 33 * 320) AS r(n)",
    "nms_corner": _nms_sql(0.3),
    "nms_centre": _nms_sql(0.15),
    "iou_join": f"SELECT * FROM (SELECT page, a_id, b_id, round({_iou('a', 'b')}, 6) AS iou FROM {_PAIRS}) WHERE iou > 0.1",
    "anchor_decode": f"SELECT vec_id, idx::INT AS idx, {_CL('(idx % 4) * 8 - ' + _DIST(1))} AS x1, {_CL('(idx // 4) * 8 - ' + _DIST(2))} AS y1, {_CL('(idx % 4) * 8 + ' + _DIST(3))} AS x2, {_CL('(idx // 4) * 8 + ' + _DIST(4))} AS y2 FROM {_CELLS}",
    "merge_edges_aabb": f"SELECT * FROM {_MERGE}",
    "edge_components": _COMPONENTS,
    "region_aabb": f"SELECT c.page, region_id, min(x1) AS x0, min(y1) AS y0, max(x2) AS x1, max(y2) AS y1, count(*) AS n_lines FROM ({_COMPONENTS}) c JOIN {B} b ON b.page = c.page AND b.id = c.id GROUP BY c.page, region_id",
    "region_angle": f"SELECT page, CASE WHEN abs(a) < 3 THEN 0.0 ELSE a END AS angle FROM (SELECT page, round(degrees(avg(acos(0.0) + (id % 9 - 4) / 40.0)) - 90, 6) AS a FROM {B} GROUP BY page)",
    "oriented_box": f"SELECT page, round(max(u) - min(u), 6) AS box_w, round(max(v) - min(v), 6) AS box_h FROM (SELECT page, cos(r) * (x - cx) + sin(r) * (y - cy) AS u, cos(r) * (y - cy) - sin(r) * (x - cx) AS v FROM (SELECT page, p.x AS x, p.y AS y, avg(p.x) OVER (PARTITION BY page) AS cx, avg(p.y) OVER (PARTITION BY page) AS cy, radians((page % 40 - 20)::DOUBLE) AS r FROM {_POINTS})) GROUP BY page",
    "majority_direction": f"SELECT * FROM {_DIR}",
    "reading_order": f"SELECT b.page, string_agg(id::VARCHAR, ',' ORDER BY CASE WHEN direction = 'h' THEN y1 + y2 ELSE -(x1 + x2) END, id) AS line_ids FROM {B} b JOIN {_DIR} d ON d.page = b.page GROUP BY b.page",
    "poly_area": f"SELECT page, id, round(abs(ax * q.by - bx * ay + bx * cy - cx * q.by + cx * dy - dx * cy + dx * ay - ax * dy) / 2, 6) AS area FROM {Q} q",
    "seg_point_distance": f"SELECT page, id, round({_seg_sql('cx', 'cy', 'ax', 'ay', 'bx', 'q.by')}, 6) AS distance FROM {Q} q",
    "poly_distance": _poly_sql(),
    "unclip": f"SELECT page, id, round(w + 2 * (w * h * 2.3 / (2 * (w + h))), 6) AS w, round(h + 2 * (w * h * 2.3 / (2 * (w + h))), 6) AS h FROM (SELECT page, id, score, x2 - x1 AS w, y2 - y1 AS h FROM {B}) WHERE least(w, h) >= 7 AND score >= 700",
    "scaled_clamped": f"SELECT page, id, greatest(0.0, least(64.0, x1 / 1.6::DOUBLE)) AS x1, greatest(0.0, least(64.0, y1 / 1.6::DOUBLE)) AS y1, greatest(0.0, least(64.0, x2 / 1.6::DOUBLE)) AS x2, greatest(0.0, least(64.0, y2 / 1.6::DOUBLE)) AS y2 FROM {B}",
    "strip_size": f"SELECT page, id, w, (w // 4 - 1)::BIGINT AS t FROM (SELECT page, id, greatest(2, floor(48 * (x2 - x1) / (y2 - y1) + 0.5)::INT) AS w FROM {B})",
}
