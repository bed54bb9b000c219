"""Queries over region rules, readers compared, model lists and resumed runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import probe as P
from ..operators import providers as V
from ..operators import raster as A
from ..operators import regions as R
from ..operators import sequence as S
from ..sources.tables import BOXES, PIXELS, QUADS, STEPS, TURNS, as_sql, bind, pixels, table

B, Q, ST, T = as_sql(BOXES), as_sql(QUADS), as_sql(STEPS), as_sql(TURNS)
SOURCES = "SELECT page, i, CASE WHEN i % 4 = 0 THEN concat(' ', chr(9), chr(10)) ELSE source END AS source FROM (" + TURNS + ") AS t"
#: Drawn regions: boxes with texts, angles and sizes of their turned boxes.
DRAWN = """
    SELECT page, id, x1, y1, x2, y2, CASE WHEN id % 7 = 0 THEN ' ' ELSE 'x' END AS translated, CASE WHEN id % 14 = 0 THEN '' ELSE 's' END AS source,
           CAST(id % 9 - 4 AS DOUBLE) / 4 AS angle, (x1 + x2) / 2 + 1 AS cx, (y1 + y2) / 2 - 1 AS cy, x2 - x1 + 3 AS w, y2 - y1 + 2 AS h,
           CASE id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'vertical' ELSE 'horizontal' END AS mode, CASE WHEN y2 - y1 > x2 - x1 THEN 'v' ELSE 'h' END AS direction
    FROM (""" + BOXES + ") AS b"
_DRAWN = as_sql(DRAWN)
CHARACTERS = "SELECT doc_id, concat(text, CASE doc_id % 5 WHEN 0 THEN '日' WHEN 1 THEN 'ﾞ' WHEN 2 THEN 'ゟ' WHEN 3 THEN '㐀' ELSE '⿿' END) AS t FROM {documents}"
#: Two readers of the same lines.
READERS = ("SELECT doc_id, quality AS v FROM {labels} WHERE doc_id % 5 <> 0", "SELECT doc_id, toxic AS v FROM {labels} WHERE doc_id % 7 <> 0")
OUTPUTS = "SELECT doc_id, lang, md5(text) AS sha FROM {documents}"
EXPECTED = "SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'other' ELSE md5(d.text) END AS want FROM {documents} AS d WHERE d.doc_id % 3 <> 0"
#: Steps of a run and what became of them.
STATE = "SELECT user_id * 10 + event_id % 10 AS step, CASE WHEN event_id % 17 = 0 THEN 'done' WHEN event_id % 23 = 0 THEN 'crashed' WHEN event_id % 5 = 0 THEN 'interrupted' ELSE 'started' END AS what FROM {events}"
#: The kinds of work in one round; one of them comes twice.
ROUND = ["view", "click", "view", "purchase", "signup"]
PROVIDERS = [(1, "alpha", False, "http://a/chat", "http://a/models"), (2, "beta", True, "", ""), (3, "gamma", False, "http://g/chat", "http://g/models")]
ASKED = """
    SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'unknown' END AS provider,
           CASE WHEN s_suppkey % 2 = 0 THEN ' http://u/v1/ ' ELSE 'http://u' END AS base FROM {supplier}"""
REPLIES = """
    SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'openai' ELSE 'gemini' END AS source, CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE 'http://u' END AS url,
           CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'k' END AS key, CASE WHEN s_suppkey % 7 = 0 THEN 401 ELSE 200 END AS status,
           replace(replace(CASE WHEN s_suppkey % 7 = 0 THEN repeat('e', 400) WHEN s_suppkey % 5 = 0 THEN 'oops' WHEN s_suppkey % 3 = 1 THEN '<"data": [<"id": "z">, <"id": "b">, <"id": "c">]>'
                ELSE '<"models": [<"name": "models/n", "supportedGenerationMethods": ["generateContent"]>, <"name": "models/e", "supportedGenerationMethods": ["embed"]>, <"name": "x/a", "supportedGenerationMethods": ["generateContent"]>]>' END, '<', chr(123)), '>', chr(125)) AS body
    FROM {supplier}"""


def _drawn(s, d):
    return bind(s, d, DRAWN)


def _rounded(points, n=6):
    return [F.round(v, n).alias(f"{c}{i}") for i, p in enumerate(points) for c, v in zip("xy", p, strict=True)]


def _rect(s, d):
    b = _drawn(s, d)
    u = F.cos(F.col("angle")), F.sin(F.col("angle"))
    return b, lambda grow: R.rect_corners(F.col("cx"), F.col("cy"), *u, F.col("w") + 2 * grow, F.col("h") + 2 * grow)


def _rect_corners(s, d):
    b, corners = _rect(s, d)
    return b.select("page", "id", *_rounded(corners(0)))


def _expand(s, d):
    b, corners = _rect(s, d)
    return b.select("page", "id", *_rounded(R.clamp(corners(3), F.lit(64.0), F.lit(48.0))))


_RECT = lambda grow, wrap: ", ".join(f"round({wrap(f'c{axis} + ({i} * (w + {2 * grow}) * {ux} - ({j}) * (h + {2 * grow}) * {uy}) / 2', axis)}, 6) AS {axis}{k}" for k, (i, j) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))) for axis, ux, uy in (("x", "cos(angle)", "sin(angle)"), ("y", "sin(angle)", "(-cos(angle))")))


def _layout_box(s, d):
    box = R.layout_box(F.col("angle"), G.columns(), *[F.col(c) for c in ("cx", "cy", "w", "h")])
    return _drawn(s, d).select("page", "id", R.vertical(F.col("mode"), F.col("direction")).alias("vertical"), (F.abs("angle") >= R.TURN).alias("turned"), *[c.alias(k) for k, c in box.items()])


def _mask_support(s, d):
    b = _drawn(s, d)
    (x0, x1), (y0, y1) = R.support(F.col("x1") - 20, F.col("x2") - 20, 40, 64.0), R.support(F.col("y1") - 20, F.col("y2") - 20, 40, 64.0)
    return b.select("page", "id", x0.alias("x0"), y0.alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1")).where("x1 > x0 and y1 > y0")


def _window(s, d):
    b = _drawn(s, d)
    w = R.context_window(G.columns(), 96, 88)
    return b.select("page", "id", *[c.alias(k) for k, c in w.items()]).where(f"x2 - x1 >= {R.LEAST_SIDE} and y2 - y1 >= {R.LEAST_SIDE}")


def _scaled(s, d):
    q = bind(s, d, QUADS).withColumn("s", (F.col("page") % 5 + 1) / 2)
    return q.select("page", "id", *_rounded(R.scale(G.corners(), F.col("s"))))


def _line_colours(s, d):
    """Mean colour of the emitted steps of each strip but blanks (class 3); black on white where there are none."""
    steps = bind(s, d, STEPS)
    e = S.ctc_collapse(steps, order=("t", "event_id")).where("idx <> 3")
    clip = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pmod(-F.col("logp") * k, F.lit(1.5)) - 0.2))
    c = e.groupBy("strip").agg(F.avg(clip(3)).alias("f"), F.avg(clip(5)).alias("b"))
    each = steps.select("strip").distinct().join(c, "strip", "left")
    return each.select("strip", F.floor(F.coalesce("f", F.lit(0.0)) * 255 + 0.5).alias("fill"), F.floor(F.coalesce("b", F.lit(1.0)) * 255 + 0.5).alias("ground"))


_CLIP = lambda k: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (-logp * {k}) % 1.5::DOUBLE - 0.2::DOUBLE))"


def _ground(s, d):
    g = F.col("g")
    rows = pixels(s, d).where("y between 1 and 6 and g % 3 <> 0").select("img", *[c.alias(k) for k, c in (("r", 190 + g % 64), ("gr", 185 + g % 60), ("b", 200 + g % 50))])
    st = R.ground_stats(rows, "img", F.col("r"), F.col("gr"), F.col("b"))
    return st.select("img", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "red", "green", "blue", R.is_bubble(F.col("mean"), F.col("std")).alias("bubble"))


def _polygon_ground(s, d):
    """The same over the pixels inside any quadrilateral of the page and off the mask: a page's quadrilaterals are one array."""
    near = bind(s, d, QUADS).groupBy((F.col("page") % 500).alias("img")).agg(F.collect_set(F.struct(*[(F.col(f"{c}{a}") / 12).alias(f"{c}{a}") for c in "abcd" for a in "xy"])).alias("qs"))
    rows = pixels(s, d).join(near, "img").where((F.col("g") % 5 != 0) & R.in_any_polygon(F.col("x") + 0.5, F.col("y") + 0.5, F.col("qs")))
    st = R.ground_stats(rows.withColumn("c", 255 - F.col("g")), "img", F.col("g"), F.col("c"), F.col("g"))
    return st.select("img", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "red", "green", "blue")


def _inside_sql(px, py, pts):
    hits = [f"CASE WHEN ({y1} > {py}) <> ({y2} > {py}) AND {px} < ({x2} - {x1}) * ({py} - {y1}) / nullif({y2} - {y1}, 0) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(pts, [pts[-1], *pts[:-1]], strict=True)]
    return f"({' + '.join(hits)}) % 2 = 1"


def _colours(s, d):
    rgb = pixels(s, d).selectExpr("img", "y", "x", "g AS r1", "(g * 7 + x * 11) % 256 AS g1", "(g * 3 + y * 29) % 256 AS b1").withColumns({"r2": (F.col("r1") + F.col("x") * 9) % 256, "g2": (F.col("g1") + F.col("y") * 5) % 256, "b2": F.col("b1")})
    a, b = [tuple(F.col(c + k) for c in "rgb") for k in "12"]
    return rgb.select("img", "y", "x", F.round(R.colour_distance(a, b), 4).alias("distance"), F.array_join(R.outline(a, b), ",").alias("outline"), R.dark_text(a, b).alias("dark"))


_RGB2 = f"(SELECT *, (r1 + x * 9) % 256 AS r2, (g1 + y * 5) % 256 AS g2, b1 AS b2 FROM (SELECT img, y, x, g AS r1, (g * 7 + x * 11) % 256 AS g1, (g * 3 + y * 29) % 256 AS b1 FROM {PIXELS}))"
_LIN = lambda c: f"CASE WHEN {c} <= 10.31475 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE power(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_XYZ = lambda k, m: f"(({m[0]}::DOUBLE * lr{k} + {m[1]}::DOUBLE * lg{k} + {m[2]}::DOUBLE * lb{k}) / {m[3]}::DOUBLE)"
_FF = lambda t: f"CASE WHEN {t} > 0.008856 THEN power({t}, 1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {t} + 16 / 116.0::DOUBLE END"
_COLOURS = f"""(SELECT img, y, x, r1, g1, b1, r2, g2, b2, sqrt(power((l1 - l2) * 0.392::DOUBLE, 2) + power(A1 - A2, 2) + power(B_1 - B_2, 2)) AS dist FROM (
    SELECT *, {", ".join(f"floor((CASE WHEN Y{k} > 0.008856 THEN 116 * power(Y{k}, 1 / 3.0::DOUBLE) - 16 ELSE 903.3::DOUBLE * Y{k} END) * 2.55::DOUBLE + 0.5) AS l{k}, floor(500 * ({_FF(f'X{k}')} - {_FF(f'Y{k}')}) + 128.5) AS A{k}, floor(200 * ({_FF(f'Y{k}')} - {_FF(f'Z{k}')}) + 128.5) AS B_{k}" for k in "12")}
    FROM (SELECT * RENAME (x AS px, y AS py), {", ".join(f"{_XYZ(k, (0.412453, 0.357580, 0.180423, 0.950456))} AS X{k}, {_XYZ(k, (0.212671, 0.715160, 0.072169, 1.0))} AS Y{k}, {_XYZ(k, (0.019334, 0.119193, 0.950227, 1.088754))} AS Z{k}" for k in "12")}
        FROM (SELECT *, {", ".join(f"{_LIN(c + k)} AS l{c}{k}" for c in "rgb" for k in "12")} FROM {_RGB2})) ) t)"""
_COLOURS = _COLOURS.replace("SELECT img, y, x, r1", "SELECT img, py AS y, px AS x, r1", 1)


def _merge(s, d):
    b = bind(s, d, BOXES)
    side = lambda k: b.select("page", *[F.col(c).alias(k + c) for c in b.columns if c != "page"])
    font = lambda k: F.least(F.col(k + "x2") - F.col(k + "x1"), F.col(k + "y2") - F.col(k + "y1"))
    tall = lambda k: F.col(k + "y2") - F.col(k + "y1") > F.col(k + "x2") - F.col(k + "x1")
    rule = R.simple_merge(G.box_gap(G.columns("a_"), G.columns("b_")), font("a_"), font("b_"), tall("a_") == tall("b_"), 1.5, 1.0)
    return side("a_").join(side("b_"), "page").where("a_id < b_id").where(rule).select("page", "a_id", "b_id")


def _list_models(s, d):
    return V.list_models(bind(s, d, REPLIES)).select("id", F.array_join("models", ",").alias("models"), "last_error")


def _endpoints(s, d):
    p = s.createDataFrame(PROVIDERS, "ord int, provider string, editable boolean, chat string, models string")
    rows = V.provider_of(bind(s, d, ASKED), p)
    chat, models = V.endpoint(F.col("editable"), F.col("base"), F.col("chat"), F.col("models"))
    return rows.select("id", "provider", chat.alias("chat_url"), models.alias("models_url"))


def _json(s, d):
    k = F.col("s_suppkey")
    thinking = F.when(k % 3 == 0, F.create_map(F.lit("type"), F.lit("disabled"), F.lit("budget"), F.lit(None).cast("string"))).when(k % 3 == 1, F.create_map(F.lit("type"), F.lit(None).cast("string")))
    return table(s, d, "supplier").select(k.alias("id"), V.request_body(F.concat(F.lit("m"), k.cast("string")), F.when(k % 2 == 0, k % 7), thinking, F.col("s_name")).alias("body"))


def _retry_key(s, d):
    rows = bind(s, d, "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, CASE p_partkey % 3 WHEN 0 THEN 'r0' WHEN 1 THEN 'think-old' ELSE 'plain' END AS model FROM {part}")
    return V.migrate(rows, s.createDataFrame(V.RETIRED, "r_provider string, old_id string, new_id string")).select("id", F.concat_ws("|", "provider", "model").alias("retry_key"))


def _resume(s, d):
    state = bind(s, d, STATE)
    return R.to_resume(state.select("step").distinct(), state)


def _readers(s, d):
    a, b = (bind(s, d, q) for q in READERS)
    both = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), "doc_id", "full")
    return both.groupBy((F.col("doc_id") % 10).alias("part")).agg(F.round(100 * F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")), 6).alias("percent"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("doc_id")))).cast("array<string>"), ",").alias("differ"))


def _digest(s, d):
    """Digest over a customer's orders in order; `=` stands for a tier that repeats the one before."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return P.ordered_digest(o.withColumn("data", F.when(before == F.col("o_orderstatus"), "=").otherwise(F.concat(F.lit("1x1"), "o_orderstatus"))), "o_custkey", "o_orderkey", "data")


def _ratio(s, d):
    e = table(s, d, "events")
    times = e.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return P.weighted_ratio(times, "user_id", ROUND)


QUERIES = {
    "nonblank_regions": lambda s, d: bind(s, d, SOURCES).where(R.readable(F.col("source"))).select("page", "i"),
    "render_gate": lambda s, d: _drawn(s, d).where(R.renderable(F.col("translated"), F.col("source"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).select("page", "id"),
    "cjk_test": lambda s, d: bind(s, d, CHARACTERS).select("doc_id", R.is_cjk(F.col("t")).alias("cjk")),
    "orientation": _layout_box,
    "rect_corners": _rect_corners,
    "expand_clamp": _expand,
    "mask_support": _mask_support,
    "context_window": _window,
    "scale_lines": _scaled,
    "cubic_weights": lambda s, d: table(s, d, "part").select("p_partkey", F.round(R.cubic_weight((F.col("p_partkey") % 500 - 250) / 100, -0.75), 9).alias("w")),
    "strip_normalise": lambda s, d: A.strip(pixels(s, d), R.MARGIN).withColumn("v", F.round("v", 6)),
    "component_boxes": lambda s, d: A.component_boxes(A.components8(pixels(s, d).where("g > 200").select("img", "y", "x"), 8)),
    "line_colours": _line_colours,
    "bubble_test": _ground,
    "polygon_ground": _polygon_ground,
    "colour_difference": _colours,
    "gap_merge": _merge,
    "expected_sha": lambda s, d: R.compare_outputs(bind(s, d, OUTPUTS), bind(s, d, EXPECTED), "doc_id", "lang"),
    "list_models": _list_models,
    "endpoint_choice": _endpoints,
    "request_json": _json,
    "retry_key": _retry_key,
    "resume_steps": _resume,
    "ab_match_rate": _readers,
    "ordered_digest": _digest,
    "weighted_ratio": _ratio,
    "recall_rate": lambda s, d: bind(s, d, TURNS).groupBy("page").agg(F.round(F.avg(R.readable(F.col("target")).cast("int")), 6).alias("recall")),
    "batch_throughput": lambda s, d: P.batch_throughput(table(s, d, "orders").selectExpr("o_custkey % 5 + 1 AS depth", "o_totalprice AS ms", "o_orderstatus = 'F' AS ok")).withColumn("per_page", F.round("per_page", 2)),
    "class_argmax": lambda s, d: S.class_argmax(table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 2).alias("c")), "c", 2, 0.25).withColumn("score", F.round("score", 6)),
}
_SUP = lambda lo, hi: (f"greatest(0, trunc(({lo} - 20) * 40 / 64.0::DOUBLE)::INT)", f"least(40, ceil(({hi} - 20) * 40 / 64.0::DOUBLE)::INT)")
_WIN = lambda a, b, most: (f"greatest(0, trunc(({a} + {b}) / 2 - ({b} - {a}) * 1.7::DOUBLE / 2)::INT)", f"least({most}, trunc(({a} + {b}) / 2 + ({b} - {a}) * 1.7::DOUBLE / 2)::INT)")
_GAPS = "sqrt(power(greatest(0.0, b.x1 - a.x2, a.x1 - b.x2), 2) + power(greatest(0.0, b.y1 - a.y2, a.y1 - b.y2), 2))"
_FONT = lambda k: f"least({k}.x2 - {k}.x1, {k}.y2 - {k}.y1)"
_STATS = "CASE WHEN n < 16 THEN 255.0 ELSE round(mean, 6) END AS mean, CASE WHEN n < 16 THEN 0.0 ELSE round(std, 6) END AS std, CASE WHEN n < 16 THEN 255 ELSE red END AS red, CASE WHEN n < 16 THEN 255 ELSE green END AS green, CASE WHEN n < 16 THEN 255 ELSE blue END AS blue"
_SUMS = lambda r, g, b: f"count(*) AS n, avg(0.299::DOUBLE * {r} + 0.587::DOUBLE * {g} + 0.114::DOUBLE * {b}) AS mean, stddev_pop(0.299::DOUBLE * {r} + 0.587::DOUBLE * {g} + 0.114::DOUBLE * {b}) AS std, (sum({r}) // count(*))::BIGINT AS red, (sum({g}) // count(*))::BIGINT AS green, (sum({b}) // count(*))::BIGINT AS blue"
_CLEAN = lambda b: f"rtrim(trim({b}), '/')"
ORACLES = {
    "nonblank_regions": f"SELECT page, i FROM {as_sql(SOURCES)} WHERE regexp_matches(source, '\\S')",
    "render_gate": f"SELECT page, id FROM {_DRAWN} WHERE NOT (trim(translated) = '' AND trim(source) = '') AND x2 - x1 >= 8 AND y2 - y1 >= 8",
    "cjk_test": f"SELECT doc_id, regexp_matches(t, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{FF00}}-\\x{{FFEF}}]') AS cjk FROM {as_sql(CHARACTERS)}",
    "orientation": f"SELECT page, id, mode = 'vertical' OR mode = 'auto' AND direction = 'v' AS vertical, t AS turned, CASE WHEN t THEN cx - w / 2 ELSE x1 END AS x1, CASE WHEN t THEN cy - h / 2 ELSE y1 END AS y1, CASE WHEN t THEN cx + w / 2 ELSE x2 END AS x2, CASE WHEN t THEN cy + h / 2 ELSE y2 END AS y2 FROM (SELECT *, abs(angle) >= 1 AS t FROM {_DRAWN})",
    "rect_corners": f"SELECT page, id, {_RECT(0, lambda e, a: e)} FROM {_DRAWN}",
    "expand_clamp": f"SELECT page, id, {_RECT(3, lambda e, a: f'greatest(0.0::DOUBLE, least({63 if a == chr(120) else 47}.0::DOUBLE, {e}))')} FROM {_DRAWN}",
    "mask_support": f"SELECT * FROM (SELECT page, id, {_SUP('x1', 'x2')[0]} AS x0, {_SUP('y1', 'y2')[0]} AS y0, {_SUP('x1', 'x2')[1]} AS x1, {_SUP('y1', 'y2')[1]} AS y1 FROM {B}) t WHERE t.x1 > t.x0 AND t.y1 > t.y0",
    "context_window": f"SELECT * FROM (SELECT page, id, {_WIN('x1', 'x2', 96)[0]} AS x1, {_WIN('y1', 'y2', 88)[0]} AS y1, {_WIN('x1', 'x2', 96)[1]} AS x2, {_WIN('y1', 'y2', 88)[1]} AS y2 FROM {B} b) t WHERE t.x2 - t.x1 >= 8 AND t.y2 - t.y1 >= 8",
    "scale_lines": f"SELECT page, id, {', '.join(f'round({f}{a} * (page % 5 + 1) / 2, 6) AS {a}{i}' for i, f in enumerate(('q.a', 'q.b', 'q.c', 'q.d')) for a in 'xy')} FROM {Q} q",
    "cubic_weights": "SELECT p_partkey, round(CASE WHEN x <= 1 THEN ((-0.75::DOUBLE + 2) * x - (-0.75::DOUBLE + 3)) * x * x + 1 WHEN x < 2 THEN ((-0.75::DOUBLE * x + 3.75::DOUBLE) * x - 6) * x + 3 ELSE 0 END, 9) AS w FROM (SELECT p_partkey, abs((p_partkey % 500 - 250) / 100.0::DOUBLE) AS x FROM part)",
    "strip_normalise": f"SELECT img, y, x, round((g - 127.5::DOUBLE) / 127.5::DOUBLE, 6) AS v FROM {PIXELS} UNION ALL SELECT img, y, x::BIGINT, 1.0 FROM (SELECT DISTINCT img, y FROM {PIXELS}), range(8, 24) AS r(x)",
    "component_boxes": f"WITH RECURSIVE p AS MATERIALIZED (SELECT img, y, x, y * 8 + x AS pos FROM {PIXELS} WHERE g > 200), r(img, pos, root) AS (SELECT img, pos, pos FROM p UNION SELECT r.img, r.pos, q.pos FROM r JOIN p o ON o.img = r.img AND o.pos = r.root JOIN p q ON q.img = o.img AND abs(q.y - o.y) <= 1 AND abs(q.x - o.x) <= 1) SELECT img, comp::INT AS comp, min(pos % 8)::INT AS x0, min(pos // 8)::INT AS y0, (max(pos % 8) + 1)::INT AS x1, (max(pos // 8) + 1)::INT AS y1, count(*) AS n FROM (SELECT img, pos, min(root) AS comp FROM r GROUP BY img, pos) GROUP BY img, comp",
    "line_colours": f"SELECT s.strip, floor(coalesce(f, 0.0::DOUBLE) * 255 + 0.5)::BIGINT AS fill, floor(coalesce(b, 1.0::DOUBLE) * 255 + 0.5)::BIGINT AS ground FROM (SELECT DISTINCT strip FROM {ST}) s LEFT JOIN (SELECT strip, avg({_CLIP(3)}) AS f, avg({_CLIP(5)}) AS b FROM (SELECT *, lag(idx, 1, 0) OVER (PARTITION BY strip ORDER BY t, event_id) AS p FROM {ST}) WHERE idx <> 0 AND idx <> p AND idx <> 3 GROUP BY strip) c USING (strip)",
    "bubble_test": f"SELECT img, n, {_STATS}, CASE WHEN n < 16 THEN true ELSE std < 24 AND mean >= 190 END AS bubble FROM (SELECT img, {_SUMS('(190 + g % 64)', '(185 + g % 60)', '(200 + g % 50)')} FROM {PIXELS} WHERE y BETWEEN 1 AND 6 AND g % 3 <> 0 GROUP BY img)",
    "polygon_ground": f"SELECT img, n, {_STATS} FROM (SELECT img, {_SUMS('g', '(255 - g)', 'g')} FROM (SELECT DISTINCT p.img, p.y, p.x, p.g FROM {PIXELS} p JOIN {Q} q ON q.page % 500 = p.img WHERE p.g % 5 <> 0 AND {_inside_sql('(p.x + 0.5::DOUBLE)', '(p.y + 0.5::DOUBLE)', [(f'(q.{c}x / 12)', f'(q.{c}y / 12)') for c in 'abcd'])}) GROUP BY img)",
    "colour_difference": f"SELECT img, y, x, round(dist, 4) AS distance, CASE WHEN dist >= 30 THEN concat(r2, ',', g2, ',', b2) WHEN (r1 + g1 + b1) / 3.0::DOUBLE <= 127 THEN '255,255,255' ELSE '0,0,0' END AS outline, CASE WHEN abs(u - v) > 20 THEN u < v ELSE u < 128 END AS dark FROM (SELECT *, 0.299::DOUBLE * r1 + 0.587::DOUBLE * g1 + 0.114::DOUBLE * b1 AS u, 0.299::DOUBLE * r2 + 0.587::DOUBLE * g2 + 0.114::DOUBLE * b2 AS v FROM {_COLOURS})",
    "gap_merge": f"SELECT a.page, a.id AS a_id, b.id AS b_id FROM {B} a JOIN {B} b ON a.page = b.page AND a.id < b.id WHERE (a.y2 - a.y1 > a.x2 - a.x1) = (b.y2 - b.y1 > b.x2 - b.x1) AND greatest({_FONT('a')}, {_FONT('b')}) <= 1.5 * least({_FONT('a')}, {_FONT('b')}) AND {_GAPS} < least({_FONT('a')}, {_FONT('b')})",
    "expected_sha": f"SELECT lang, count(want) AS compared, count(*) FILTER (want <> sha) AS mismatches, count(*) FILTER (want IS NULL) AS no_expect FROM {as_sql(OUTPUTS)} o LEFT JOIN {as_sql(EXPECTED)} e USING (doc_id) GROUP BY lang",
    "list_models": f"SELECT id, CASE WHEN asked AND status = 200 AND body <> 'oops' THEN CASE WHEN source = 'openai' THEN 'b,c,z' ELSE 'a,n' END ELSE '' END AS models, CASE WHEN NOT asked THEN NULL WHEN status = 401 THEN 'HTTP 401 ' || left(body, 300) WHEN body = 'oops' THEN 'no list in the body' END AS last_error FROM (SELECT *, source <> 'none' AND trim(url) <> '' AND trim(key) <> '' AS asked FROM {as_sql(REPLIES)})",
    "endpoint_choice": f"SELECT id, p AS provider, CASE p WHEN 'alpha' THEN 'http://a/chat' WHEN 'gamma' THEN 'http://g/chat' ELSE CASE WHEN b LIKE '%/v1' THEN b || '/chat/completions' ELSE b || '/v1/chat/completions' END END AS chat_url, CASE p WHEN 'alpha' THEN 'http://a/models' WHEN 'gamma' THEN 'http://g/models' ELSE CASE WHEN b LIKE '%/v1' THEN b || '/models' ELSE b || '/v1/models' END END AS models_url FROM (SELECT id, CASE WHEN provider IN ('beta', 'gamma') THEN provider ELSE 'alpha' END AS p, {_CLEAN('base')} AS b FROM {as_sql(ASKED)})",
    "request_json": """SELECT s_suppkey AS id, concat('{"model":"m', s_suppkey, '"', CASE WHEN s_suppkey % 2 = 0 THEN concat(',"temperature":', s_suppkey % 7) ELSE '' END, CASE s_suppkey % 3 WHEN 0 THEN ',"thinking":{"type":"disabled"}' WHEN 1 THEN ',"thinking":{}' ELSE '' END, ',"messages":[{"role":"user","content":"', s_name, '"}]}') AS body FROM supplier""",
    "retry_key": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'alpha|r1' WHEN 1 THEN 'alpha|think-old' ELSE 'alpha|plain' END ELSE CASE p_partkey % 3 WHEN 0 THEN 'beta|r0' WHEN 1 THEN 'beta|think-new' ELSE 'beta|plain' END END AS retry_key FROM part",
    "resume_steps": f"SELECT step FROM {as_sql(STATE)} GROUP BY step HAVING bool_and(what NOT IN ('done', 'crashed')) AND count(*) FILTER (what = 'interrupted') < 2",
    "ab_match_rate": f"SELECT doc_id % 10 AS part, round(100 * avg((a.v IS NOT DISTINCT FROM b.v)::INT), 6) AS percent, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (a.v IS DISTINCT FROM b.v), '') AS differ FROM {as_sql(READERS[0])} a FULL JOIN {as_sql(READERS[1])} b USING (doc_id) GROUP BY 1",
    "ordered_digest": "SELECT o_custkey, sha256(string_agg(concat(o_orderkey, ':', CASE WHEN before = o_orderstatus THEN '=' ELSE '1x1' || o_orderstatus END), ',' ORDER BY o_orderkey)) AS digest FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY o_custkey",
    "weighted_ratio": f"SELECT user_id, round(sum(value) FILTER (event_id % 2 = 1) / sum(value) FILTER (event_id % 2 = 0), 6) AS ratio FROM events JOIN (SELECT unnest({ROUND}) AS kind) ON event_type = kind GROUP BY user_id",
    "recall_rate": f"SELECT page, round(avg(regexp_matches(target, '\\S')::INT), 6) AS recall FROM {T} GROUP BY page",
    "batch_throughput": "SELECT o_custkey % 5 + 1 AS depth, round(sum(o_totalprice) / (o_custkey % 5 + 1), 2) AS per_page, count(*) FILTER (o_orderstatus = 'F') AS n_ok FROM orders GROUP BY o_custkey % 5 + 1",
    "class_argmax": "SELECT vec_id, round(2 * list_max(embedding[1:5])::DOUBLE, 6) AS score FROM embeddings WHERE list_position(embedding[1:5], list_max(embedding[1:5])) = 3 AND 2 * list_max(embedding[1:5])::DOUBLE > 0.25",
}
