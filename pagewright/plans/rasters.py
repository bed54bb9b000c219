"""Queries over pixel relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heads as H
from ..operators import raster as R
from ..operators import sequence as S
from ..operators.images import homography
from ..sources.tables import BOXES, PIXELS as P, as_sql, bind, pixels, table

B = as_sql(BOXES)
_RGB = "(SELECT *, g AS r_, (g * 7 + x * 11) % 256 AS g_, (g * 3 + y * 29) % 256 AS b_ FROM " + P + ")"


def _rgb(s, d):
    return pixels(s, d).selectExpr("*", "g AS r_", "(g * 7 + x * 11) % 256 AS g_", "(g * 3 + y * 29) % 256 AS b_")


def _mask(s, d, mod=5):
    return pixels(s, d).withColumn("m", F.col("g") % mod == 0)




def _c():
    return F.col("r_"), F.col("g_"), F.col("b_")


def _stats(s, d):
    r, g, b = _c()
    lum = R.luminance(r, g, b)
    n = F.count(F.lit(1))
    rows = _rgb(s, d).where("y between 1 and 6 and g % 3 <> 0").groupBy("img").agg(n.alias("n"), F.avg(lum).alias("mean"), F.stddev_pop(lum).alias("std"), F.sum("r_").alias("sr"))
    few = F.col("n") < 16
    return rows.select("img", "n", F.round(F.when(few, 255.0).otherwise(F.col("mean")), 3).alias("mean"), F.round(F.when(few, 0.0).otherwise(F.col("std")), 3).alias("std"), F.when(few, 255).otherwise(F.floor(F.col("sr") / F.col("n"))).cast("bigint").alias("red"))


def _border(s, d):
    edge = (F.col("y") < 2) | (F.col("y") > 5) | (F.col("x") < 2) | (F.col("x") > 5)
    r = F.round(100 * F.avg(F.when(F.col("g") < 128, 1.0).otherwise(0.0)), 6)
    return pixels(s, d).where(edge).groupBy("img").agg(r.alias("black"), ((r >= 40) & (r <= 60)).alias("skip"))


def _colour(s, d):
    r, g, b = _c()
    grey = R.grey(r, g, b)
    dist = (r - grey) * (r - grey) + (g - grey) * (g - grey) + (b - grey) * (b - grey)
    return _rgb(s, d).groupBy("img").agg((F.sum(F.when(dist > 100, 1).otherwise(0)) > 10).alias("colour"))


def _in_boxes(s, d):
    """Masked pixels inside any padded box of their page: the distinct ranges of pixels that the boxes of a page cover are one array, so no
    range join. Boxes have whole coordinates, so the ranges are exact, and a page of any number of boxes has few of them."""
    ranges = [F.ceil((F.col(a) - 2) / 12).alias(a) for a in ("x1", "y1")] + [F.floor((F.col(b) + 2) / 12).alias(b) for b in ("x2", "y2")]
    covered = bind(s, d, BOXES).select((F.col("page") % 500).alias("img"), *ranges).distinct()
    boxes = covered.groupBy("img").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("bs"))
    m = _mask(s, d).where("m").join(boxes, "img")
    hit = F.exists("bs", lambda r: F.col("x").between(r["x1"], r["x2"]) & F.col("y").between(r["y1"], r["y2"]))
    return m.where(hit).select("img", "y", "x")


def _maps(s, d, cell):
    """Each vector as a page of 8 x 8 maps, and e, its numbers."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("page"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return v.selectExpr("*", "8 AS height", "8 AS width", f"flatten(transform(sequence(0, 63), p -> {cell})) AS values")


def _on_mask(masks):
    """How many pixels of a mask are on, and the sum of their places."""
    on = F.expr("filter(sequence(0, size(mask) - 1), i -> mask[i])")
    return masks.select(F.col("page").alias("vec_id"), F.size(on).cast("bigint").alias("n_on"), F.aggregate(on, F.lit(0).cast("bigint"), lambda a, i: a + i).alias("places"))


def _mask_head(s, d):
    """Two instances a vector through the 10-8-8-1 head over eight maps, on a page of 48 x 40."""
    kernel = "transform(sequence(0, 168), i -> e[(11 * i + 3 + 5 * j) % 64] * 8)"
    instance = f"named_struct('x', CAST((page + 3 * j) % 8 * 8 AS DOUBLE), 'y', CAST((page DIV 8 + j) % 8 * 8 AS DOUBLE), 'stride', CAST(8 * pow(2, (page + j) % 3) AS INT), 'score', 0.25D + 0.1D * ((page + j) % 3), 'kernel', {kernel})"
    maps = _maps(s, d, "transform(sequence(0, 7), c -> e[(p + 7 * c) % 64] * (1 + c))")
    pages = maps.selectExpr("page", "height", "width", "values", "56 AS inner_h", "48 AS inner_w", "48 AS page_h", "40 AS page_w", f"transform(array(0, 1), j -> {instance}) AS instances")
    return _on_mask(H.dynamic_masks(pages))


def _proto_mask(s, d):
    """Two instances a vector from 32 prototypes, in a square of 32 with a page of 28 x 20 in the middle."""
    instance = "named_struct('cx', CAST((page * 7 + 13 * j) % 40 AS DOUBLE), 'cy', CAST((page * 5 + 11 * j) % 36 AS DOUBLE), 'w', CAST(3 + (page + j) % 17 AS DOUBLE), 'h', CAST(4 + (page * 3 + j) % 19 AS DOUBLE), 'coefficients', transform(sequence(0, 31), c -> e[(3 * c + 17 * j) % 64] * 4))"
    maps = _maps(s, d, "transform(sequence(0, 31), c -> e[(p + 5 * c) % 64])")
    pages = maps.selectExpr("page", "height", "width", "values", "0 AS top", "4 AS left", "32 AS inner_h", "23 AS inner_w", "28 AS page_h", "20 AS page_w", f"transform(array(0, 1), j -> {instance}) AS instances")
    return _on_mask(H.prototype_masks(pages, 32))


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, j FROM embeddings, (SELECT unnest([0, 1]) AS j)"
_BETWEEN = lambda v: f"(list_extract({v}, y0 * w0 + x0 + 1) * (1 - fx) + list_extract({v}, y0 * w0 + x1 + 1) * fx) * (1 - fy) + (list_extract({v}, y1 * w0 + x0 + 1) * (1 - fx) + list_extract({v}, y1 * w0 + x1 + 1) * fx) * fy"


def _axis(name, src, dst):
    """SQL of half-pixel taps of an axis: name, name0, name1, f + name."""
    pos = f"greatest(0.0, least({src - 1}.0, ({name} + 0.5) * ({src}::DOUBLE / {dst}) - 0.5))"
    return f"(SELECT {name}, floor({pos})::INT AS {name}0, least(floor({pos})::INT + 1, {src - 1}) AS {name}1, {pos} - floor({pos}) AS f{name} FROM (SELECT unnest(range({dst})) AS {name}))"


_MASK_HEAD_SQL = f"""
    WITH v AS (SELECT *, list_transform(range(169), lambda i: list_extract(e, (11 * i + 3 + 5 * j) % 64 + 1) * 8) AS k FROM ({_VECTORS}) WHERE (vec_id + j) % 3 > 0),
    a AS (SELECT vec_id, j, k, p, list_concat([((vec_id + 3 * j) % 8 * 8 - p % 8 * 8) / (64.0::DOUBLE * (1 << ((vec_id + j) % 3))::INT), ((vec_id // 8 + j) % 8 * 8 - p // 8 * 8) / (64.0::DOUBLE * (1 << ((vec_id + j) % 3))::INT)],
                 list_transform(range(8), lambda c: list_extract(e, (p + 7 * c) % 64 + 1) * (1 + c))) AS a FROM v, (SELECT unnest(range(64)) AS p)),
    b AS (SELECT vec_id, j, k, p, list_transform(range(8), lambda o: greatest(0, list_extract(k, 153 + o) + list_dot_product(k[o * 10 + 1 : o * 10 + 10], a))) AS b FROM a),
    c AS (SELECT vec_id, j, k, p, list_transform(range(8), lambda o: greatest(0, list_extract(k, 161 + o) + list_dot_product(k[81 + o * 8 : 88 + o * 8], b))) AS c FROM b),
    g AS (SELECT vec_id, j, 8 AS w0, list(k[169] + list_dot_product(k[145:152], c) ORDER BY p) AS g FROM c GROUP BY vec_id, j),
    u AS (SELECT vec_id, y, x, bool_or({_BETWEEN("g")} > 0) AS m FROM g, {_axis("y", 8, 64)} ys, {_axis("x", 8, 64)} xs GROUP BY vec_id, y, x),
    t AS (SELECT vec_id, py * 40 + px AS i FROM (SELECT unnest(range(48)) AS py), (SELECT unnest(range(40)) AS px), u WHERE m AND y = floor(py * (56.0::DOUBLE / 48)) AND x = floor(px * (48.0::DOUBLE / 40)))
    SELECT embeddings.vec_id, count(i) AS n_on, coalesce(sum(i), 0)::BIGINT AS places FROM embeddings LEFT JOIN t USING (vec_id) GROUP BY embeddings.vec_id"""
_PROTO_MASK_SQL = f"""
    WITH v AS (SELECT *, list_transform(range(32), lambda c: list_extract(e, (3 * c + 17 * j) % 64 + 1) * 4) AS k,
                      (vec_id * 7 + 13 * j) % 40 AS cx, (vec_id * 5 + 11 * j) % 36 AS cy, 3 + (vec_id + j) % 17 AS bw, 4 + (vec_id * 3 + j) % 19 AS bh FROM ({_VECTORS})),
    m AS (SELECT vec_id, j, 8 AS w0, list(CASE WHEN p % 8 BETWEEN floor((cx - bw / 2.0) / 4) AND ceil((cx + bw / 2.0) / 4) - 1 AND p // 8 BETWEEN floor((cy - bh / 2.0) / 4) AND ceil((cy + bh / 2.0) / 4) - 1
                 THEN 1 / (1 + exp(-list_dot_product(list_transform(range(32), lambda c: list_extract(e, (p + 5 * c) % 64 + 1)), k))) ELSE 0.0::DOUBLE END ORDER BY p) AS m
          FROM v, (SELECT unnest(range(64)) AS p) GROUP BY vec_id, j),
    n AS (SELECT vec_id, j, 23 AS w0, list({_BETWEEN("m")} ORDER BY y, x) AS n FROM m, {_axis("y", 8, 32)} ys, {_axis("x", 8, 32)} xs WHERE x BETWEEN 4 AND 26 GROUP BY vec_id, j),
    u AS (SELECT vec_id, y * 20 + x AS i FROM n, {_axis("y", 32, 28)} ys, {_axis("x", 23, 20)} xs GROUP BY vec_id, y, x HAVING bool_or({_BETWEEN("n")} > 0.5))
    SELECT embeddings.vec_id, count(i) AS n_on, coalesce(sum(i), 0)::BIGINT AS places FROM embeddings LEFT JOIN u USING (vec_id) GROUP BY embeddings.vec_id"""


#: Corners of the warp: from a leaning quadrilateral to an upright square of 4 x 4.
_H = [float(x) for x in homography([(0, 0), (7, 1), (6, 7), (1, 6)], [(0, 0), (3, 0), (3, 3), (0, 3)]).ravel()[:8]]


def _warp(s, d):
    return R.warp(pixels(s, d), 8, 4, _H, "g").withColumn("g", F.round("g", 6))


def _sizes(s, d):
    return table(s, d, "part").selectExpr("p_partkey AS id", "CAST(100 + p_partkey % 3000 AS BIGINT) AS w", "CAST(90 + (p_partkey * 7) % 4000 AS BIGINT) AS h")


_SIZES = "(SELECT p_partkey AS id, (100 + p_partkey % 3000)::BIGINT AS w, (90 + (p_partkey * 7) % 4000)::BIGINT AS h FROM part)"


def _resize(s, d):
    ratio = F.lit(1024.0) / F.greatest("w", "h")
    rnd = lambda c: F.floor(F.col(c) * ratio + 0.5).cast("bigint")
    pad = lambda c: (F.ceil(rnd(c) / 256) * 256).cast("bigint")
    return _sizes(s, d).select("id", rnd("w").alias("tw"), rnd("h").alias("th"), pad("w").alias("in_w"), pad("h").alias("in_h"), F.round(ratio, 9).alias("ratio"))


def _fits(s, d):
    return _sizes(s, d).select("id", R.fits_page(F.floor(F.col("w") / 2), F.floor(F.col("h") / 2) + F.col("id") % 9 - 4, F.col("w"), F.col("h")).alias("fits"))


def _budget(s, d):
    w, h = R.budget(F.col("w"), F.col("h"), 3_500_000)
    return _sizes(s, d).select("id", w.cast("bigint").alias("w"), h.cast("bigint").alias("h"))


_N = lambda i, n: f"list_extract(gs, greatest(0, least(7, y + {i})) * 8 + greatest(0, least(7, x + {n})) + 1)"
_ARR = f"(SELECT img, y, x, p.g AS c, a.gs FROM {P} p JOIN (SELECT img AS i2, list(g ORDER BY y, x) AS gs FROM {P} GROUP BY img) a ON a.i2 = p.img)"
_NEAR = "least(floor({0} * (1.0::DOUBLE / (11.0::DOUBLE / 8.0::DOUBLE)))::INT, 7)"
_GRID = lambda n: f"(SELECT img, y, x FROM (SELECT DISTINCT img FROM {P}), range(0, {n}) AS a(y), range(0, {n}) AS b(x))"
_POS = "greatest(0.0::DOUBLE, least(7.0::DOUBLE, ({0} + 0.5::DOUBLE) * (8.0::DOUBLE / 12.0::DOUBLE) - 0.5::DOUBLE))"

QUERIES = {
    "gray_chroma": lambda s, d: _rgb(s, d).select("img", "y", "x", R.grey(*_c()).alias("grey"), R.chroma(*_c()).alias("chroma")),
    "normalise": lambda s, d: pixels(s, d).select("img", "y", "x", F.round(F.col("g") / 127.5 - 1, 6).alias("v"), F.when(F.col("g") % 5 == 0, 0.0).otherwise(F.round((F.col("g") - 127.5) / 127.5, 6)).alias("masked")),
    "denormalise": lambda s, d: pixels(s, d).select("img", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), ((F.col("v") / 300.0 + 1) * 127.5).cast("int"))).alias("g")),
    "pack_argb": lambda s, d: pixels(s, d).select("img", "y", "x", F.expr("shiftleft(255, 24) | shiftleft(g, 16) | shiftleft(g, 8) | g").alias("argb")),
    "luminance_stats": _stats,
    "border_black_ratio": _border,
    "colour_text": _colour,
    "dilate": lambda s, d: R.dilate(_mask(s, d, 17).withColumn("m", F.col("m").cast("int")), 2).select("img", "y", "x", "m"),
    "unsharp5": lambda s, d: R.unsharp5(pixels(s, d), 1.6).select("img", "y", "x", "g"),
    "unsharp9": lambda s, d: R.unsharp9(pixels(s, d), 0.5).select("img", "y", "x", "g"),
    "resample_nearest": lambda s, d: R.resample_nearest(pixels(s, d), 8, 11),
    "resample_bilinear": lambda s, d: R.resample_bilinear(pixels(s, d), 8, 12).withColumn("v", F.round("v", 3) + F.lit(0.0)),
    "resample_area": lambda s, d: R.resample_area(pixels(s, d), 8, 3).withColumn("v", F.round("v", 6)),
    "mask_union": lambda s, d: _mask(s, d).groupBy("label", "y", "x").agg(F.bool_or("m").alias("m")),
    "mask_intersection": lambda s, d: _mask(s, d, 2).where("m").select("img", "y", "x").join(_mask(s, d, 3).where("m").select("img", "y", "x"), ["img", "y", "x"]),
    "mask_iou": lambda s, d: pixels(s, d).groupBy("img").agg(F.sum(((F.col("g") % 2 == 0) & (F.col("g") % 3 == 0)).cast("bigint")).alias("both"), F.sum(((F.col("g") % 2 == 0) | (F.col("g") % 3 == 0)).cast("bigint")).alias("either")).select("img", F.round(F.try_divide("both", "either"), 6).alias("iou"), (F.col("either") - F.col("both")).alias("differ")),
    "mask_in_boxes": _in_boxes,
    "composite": lambda s, d: pixels(s, d).select("img", "y", "x", F.when(F.col("g") % 5 == 0, 255 - F.col("g")).otherwise(F.col("g")).alias("g")),
    "nearest_fill_4dir": lambda s, d: R.fill_from_sides(_mask(s, d, 3), "m", "g", 3).select("img", "y", "x", F.round("g", 6).alias("g")),
    "budget_size": _budget,
    "resize_aspect_dims": _resize,
    "mask_fits_page": _fits,
    "tier_dedupe": lambda s, d: S.dedupe_consecutive(table(s, d, "lineitem").selectExpr("l_partkey AS page", "(l_orderkey * 1000 + l_linenumber) * 100000 + l_suppkey AS k", "l_returnflag AS tier"), "page", ("k",), "tier").select("page", "k", "tier"),
    "extra_lines_union": lambda s, d: bind(s, d, BOXES).where("score < 500").selectExpr("page", "id", "x1").unionByName(bind(s, d, BOXES).where("score >= 500").selectExpr("page", "id", "x1 * 2 AS x1")),
    "pixel_components": lambda s, d: R.components8(pixels(s, d).where("g > 200").select("img", "y", "x"), 8),
    "rotate_ccw": lambda s, d: pixels(s, d).select("img", (7 - F.col("x")).alias("y"), F.col("y").alias("x"), "g"),
    "perspective_warp": _warp,
    "mask_head": _mask_head,
    "proto_mask": _proto_mask,
}
_LUM = "0.299::DOUBLE * r_ + 0.587::DOUBLE * g_ + 0.114::DOUBLE * b_"
_GREY = "((299 * r_ + 587 * g_ + 114 * b_ + 500) // 1000)"
_FILL = lambda order, frame, part, f: f"{f}(CASE WHEN g % 3 <> 0 THEN g END IGNORE NULLS) OVER (PARTITION BY img, {part} ORDER BY {order} ROWS BETWEEN {frame})"
_D = [f"({x!r}::DOUBLE)" for x in _H]
_W = f"({_D[6]} * x + {_D[7]} * y + 1)"
_TAP = lambda dy, dx: f"(CASE {dy} WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE {dx} WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * list_extract(gs, (greatest(0, least(7, floor(v) + {dy})) * 8 + greatest(0, least(7, floor(u) + {dx})) + 1)::INT)"
_WARP_SQL = f"""
    SELECT img, y, x, round({" + ".join(_TAP(dy, dx) for dy in (0, 1) for dx in (0, 1))}, 6) AS g
    FROM (SELECT *, ({_D[0]} * x + {_D[1]} * y + {_D[2]}) / {_W} AS u, ({_D[3]} * x + {_D[4]} * y + {_D[5]}) / {_W} AS v
          FROM (SELECT img, list(g ORDER BY y, x) AS gs FROM {P} GROUP BY img), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x))"""
ORACLES = {
    "mask_head": _MASK_HEAD_SQL,
    "proto_mask": _PROTO_MASK_SQL,
    "gray_chroma": f"SELECT img, y, x, {_GREY}::INT AS grey, greatest(r_, g_, b_) - least(r_, g_, b_) AS chroma FROM {_RGB}",
    "normalise": f"SELECT img, y, x, round(g / 127.5::DOUBLE - 1, 6) AS v, CASE WHEN g % 5 = 0 THEN 0.0 ELSE round((g - 127.5::DOUBLE) / 127.5::DOUBLE, 6) END AS masked FROM {P}",
    "denormalise": f"SELECT img, y, x, greatest(0, least(255, trunc((v / 300.0::DOUBLE + 1) * 127.5::DOUBLE)::INT)) AS g FROM {P}",
    "pack_argb": f"SELECT img, y, x, -16777216 + g * 65536 + g * 256 + g AS argb FROM {P}",
    "luminance_stats": f"SELECT img, count(*) AS n, round(CASE WHEN count(*) < 16 THEN 255.0 ELSE avg({_LUM}) END, 3) AS mean, round(CASE WHEN count(*) < 16 THEN 0.0 ELSE stddev_pop({_LUM}) END, 3) AS std, CASE WHEN count(*) < 16 THEN 255 ELSE sum(r_) // count(*) END::BIGINT AS red FROM {_RGB} WHERE y BETWEEN 1 AND 6 AND g % 3 <> 0 GROUP BY img",
    "border_black_ratio": f"SELECT img, b AS black, b BETWEEN 40 AND 60 AS skip FROM (SELECT img, round(100 * avg(CASE WHEN g < 128 THEN 1.0 ELSE 0.0 END), 6) AS b FROM {P} WHERE y < 2 OR y > 5 OR x < 2 OR x > 5 GROUP BY img)",
    "colour_text": f"SELECT img, sum(CASE WHEN (r_ - k) * (r_ - k) + (g_ - k) * (g_ - k) + (b_ - k) * (b_ - k) > 100 THEN 1 ELSE 0 END) > 10 AS colour FROM (SELECT *, {_GREY} AS k FROM {_RGB}) GROUP BY img",
    "dilate": f"SELECT a.img, a.y, a.x, max((b.g % 17 = 0)::INT) AS m FROM {P} a JOIN {P} b ON a.img = b.img AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL",
    "unsharp5": f"SELECT img, y, x, greatest(0, least(255, trunc(c + 1.6::DOUBLE * (c - (c + {_N(0, -1)} + {_N(0, 1)} + {_N(-1, 0)} + {_N(1, 0)}) / 5::DOUBLE))::INT)) AS g FROM {_ARR}",
    "unsharp9": f"SELECT img, y, x, greatest(0, least(255, floor(c + 0.5::DOUBLE * (c - ({' + '.join(_N(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))}) / 9::DOUBLE) + 0.5::DOUBLE)::INT)) AS g FROM {_ARR}",
    "resample_nearest": f"SELECT t.img, t.y, t.x, p.v FROM {_GRID(11)} t JOIN {P} p ON p.img = t.img AND p.y = {_NEAR.format('t.y')} AND p.x = {_NEAR.format('t.x')}",
    "resample_bilinear": f"SELECT t.img, t.y, t.x, round(sum(greatest(0.0, 1 - abs(p.y - {_POS.format('t.y')})) * greatest(0.0, 1 - abs(p.x - {_POS.format('t.x')})) * p.v), 3) + 0.0 AS v FROM {_GRID(12)} t JOIN {P} p ON p.img = t.img GROUP BY ALL",
    "resample_area": f"SELECT img, y, x, round(sum(wy * wx * v), 6) AS v FROM (SELECT t.img, t.y, t.x, p.v, greatest(0.0, least((t.y + 1) * (8.0::DOUBLE / 3), p.y + 1) - greatest(t.y * (8.0::DOUBLE / 3), p.y)) / (8.0::DOUBLE / 3) AS wy, greatest(0.0, least((t.x + 1) * (8.0::DOUBLE / 3), p.x + 1) - greatest(t.x * (8.0::DOUBLE / 3), p.x)) / (8.0::DOUBLE / 3) AS wx FROM {_GRID(3)} t JOIN {P} p ON p.img = t.img) GROUP BY img, y, x",
    "mask_union": f"SELECT label, y, x, bool_or(g % 5 = 0) AS m FROM {P} GROUP BY ALL",
    "mask_intersection": f"SELECT img, y, x FROM {P} WHERE g % 6 = 0",
    "mask_iou": f"SELECT img, round(CASE WHEN e > 0 THEN b / e END, 6) AS iou, (e - b)::BIGINT AS differ FROM (SELECT img, sum((g % 6 = 0)::INT) AS b, sum((g % 2 = 0 OR g % 3 = 0)::INT) AS e FROM {P} GROUP BY img)",
    "mask_in_boxes": f"SELECT DISTINCT p.img, p.y, p.x FROM {P} p JOIN {B} b ON b.page % 500 = p.img AND x * 12 BETWEEN x1 - 2 AND x2 + 2 AND y * 12 BETWEEN y1 - 2 AND y2 + 2 WHERE g % 5 = 0",
    "composite": f"SELECT img, y, x, CASE WHEN g % 5 = 0 THEN 255 - g ELSE g END AS g FROM {P}",
    "nearest_fill_4dir": f"SELECT img, y, x, round(CASE WHEN g % 3 = 0 THEN coalesce(list_avg([a, b, c, e]), g::DOUBLE) ELSE g::DOUBLE END, 6) AS g FROM (SELECT *, {_FILL('x', '3 PRECEDING AND 1 PRECEDING', 'y', 'last_value')} AS a, {_FILL('x', '1 FOLLOWING AND 3 FOLLOWING', 'y', 'first_value')} AS b, {_FILL('y', '3 PRECEDING AND 1 PRECEDING', 'x', 'last_value')} AS c, {_FILL('y', '1 FOLLOWING AND 3 FOLLOWING', 'x', 'first_value')} AS e FROM {P})",
    "budget_size": f"SELECT id, CASE WHEN w * h <= 3500000 THEN w ELSE greatest(1, floor(w * sqrt(3500000.0 / (w * h)))::BIGINT) END AS w, CASE WHEN w * h <= 3500000 THEN h ELSE greatest(1, floor(h * sqrt(3500000.0 / (w * h)))::BIGINT) END AS h FROM {_SIZES}",
    "resize_aspect_dims": f"SELECT id, tw, th, (ceil(tw / 256) * 256)::BIGINT AS in_w, (ceil(th / 256) * 256)::BIGINT AS in_h, round(r, 9) AS ratio FROM (SELECT id, r, floor(w * r + 0.5)::BIGINT AS tw, floor(h * r + 0.5)::BIGINT AS th FROM (SELECT *, 1024.0::DOUBLE / greatest(w, h) AS r FROM {_SIZES}))",
    "mask_fits_page": f"SELECT id, mw > 0 AND mh > 0 AND abs(mw * h - mh * w) <= 2 * (mw + mh + w + h) AS fits FROM (SELECT *, w // 2 AS mw, h // 2 + id % 9 - 4 AS mh FROM {_SIZES})",
    "tier_dedupe": "SELECT page, k, tier FROM (SELECT *, lag(tier) OVER (PARTITION BY page ORDER BY k) AS b FROM (SELECT l_partkey AS page, (l_orderkey * 1000 + l_linenumber) * 100000 + l_suppkey AS k, l_returnflag AS tier FROM lineitem)) WHERE b IS NULL OR b <> tier",
    "extra_lines_union": f"SELECT page, id, CASE WHEN score < 500 THEN x1 ELSE x1 * 2 END AS x1 FROM {B}",
    "pixel_components": f"WITH RECURSIVE p AS MATERIALIZED (SELECT img, y, x, y * 8 + x AS pos FROM {P} WHERE g > 200), r(img, pos, root) AS (SELECT img, pos, pos FROM p UNION SELECT r.img, r.pos, q.pos FROM r JOIN p o ON o.img = r.img AND o.pos = r.root JOIN p q ON q.img = o.img AND abs(q.y - o.y) <= 1 AND abs(q.x - o.x) <= 1) SELECT img, (pos // 8)::INT AS y, (pos % 8)::INT AS x, min(root) AS comp FROM r GROUP BY img, pos",
    "perspective_warp": _WARP_SQL,
    "rotate_ccw": f"SELECT img, 7 - x AS y, y AS x, g FROM {P}",
}
