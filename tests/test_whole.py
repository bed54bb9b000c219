"""Whole jobs: queries against brute force over all their input."""

import math
import re

from compare import DATA

from pagewright.operators import grouping as G
from pagewright.operators import layout as L
from pagewright.plans import catalog
from pagewright.sources.tables import pixels


def rows(spark, name, data=DATA):
    return [tuple(r) for r in catalog.QUERIES[name](spark, data).collect()]


def test_graph_mask_uses_every_edge(spark, tmp_path):
    part, edges = range(1, 31), [(o, p, 1 + (o * p) % 29) for o in range(1, 23) for p in range(1, 31) if (p % 2 or o == 7) and (o * p) % 29 % 5 in (0, 1, 2, 4)]
    spark.createDataFrame([(p,) for p in part], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    edges = [(o, p, q) for o, p, q in edges if p % 9 or q % 13]
    spark.createDataFrame(edges, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    unsafe = {p for _, p, q in edges if q % 13 == 0}
    masked = {p for p in part if p % 3 == 0}
    assert masked & unsafe and masked - unsafe
    assert masked & unsafe - {p for o, p, q in edges if q % 13 == 0 and o % 20 == 0}
    assert {r[0] for r in rows(spark, "graph_mask_check", str(tmp_path))} == masked - unsafe


def boxes(spark, view):
    from pagewright.sources.tables import BOXES, QUADS, bind

    pages = {}
    for r in bind(spark, DATA, {"boxes": BOXES, "quads": QUADS}[view]).collect():
        pages.setdefault(r["page"], []).append(r)
    return {p: sorted(rs, key=lambda r: r["id"]) for p, rs in pages.items()}


def test_merge_edges_follow_the_whole_rule(spark):
    quad = lambda r: [(r["x1"], r["y1"]), (r["x2"], r["y1"]), (r["x2"], r["y2"]), (r["x1"], r["y2"])]
    edges, regions, around = set(), set(), set()
    for page, rs in boxes(spark, "boxes").items():
        lines = [G.Line(quad(r)) for r in rs]
        own = [(i, j) for j in range(len(rs)) for i in range(j) if rs[i]["id"] < rs[j]["id"] and G.may_merge(lines[i], lines[j])]
        edges |= {(page, rs[i]["id"], rs[j]["id"]) for i, j in own}
        same = [(i, i + 1) for i in range(len(rs) - 1) if rs[i]["id"] == rs[i + 1]["id"]]  # a line item may occur twice
        for c in G.components(len(rs), own + same):
            regions |= {(page, rs[m]["id"], rs[c[0]]["id"]) for m in c}
            around.add((page, rs[c[0]]["id"], *[f(rs[m][k] for m in c) for f, k in ((min, "x1"), (min, "y1"), (max, "x2"), (max, "y2"))], len(c)))
    assert edges and set(rows(spark, "merge_edges_aabb")) == edges
    assert set(rows(spark, "edge_components")) == regions
    assert set(rows(spark, "region_aabb")) == around


def test_mask_in_boxes_uses_every_box(spark):
    pages = {}
    for p, rs in boxes(spark, "boxes").items():
        pages.setdefault(p % 500, []).extend(rs)
    inside = lambda r, y, x: r["x1"] - 2 <= x * 12 <= r["x2"] + 2 and r["y1"] - 2 <= y * 12 <= r["y2"] + 2
    want = {(p["img"], p["y"], p["x"]) for p in pixels(spark, DATA).where("g % 5 = 0").collect() if any(inside(r, p["y"], p["x"]) for r in pages.get(p["img"], []))}
    got = rows(spark, "mask_in_boxes")
    assert want and len(got) == len(want) and set(got) == want


def test_poly_distance_of_every_pair(spark):
    quads = {p: [(r["id"], [(r[f"{c}x"], r[f"{c}y"]) for c in "abcd"]) for r in rs] for p, rs in boxes(spark, "quads").items()}
    want = {(p, i, j): G.polygon_distance(a, b) for p, rs in quads.items() for k, (j, b) in enumerate(rs) for i, a in rs[:k] if i < j}
    got = {r[:3]: r[3] for r in rows(spark, "poly_distance")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_layout_of_whole_texts(spark, tmp_path):
    texts = ["", "「あ」、。！" * 40, "Long words, 12 of them!? And AB more 日本語。 " * 300, "x\ny " * 20, "a" * 5000]
    docs = [(i * 7 + k, t) for i, t in enumerate(texts) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cells, fit, columns, placed, wrapped = {}, {}, {}, {}, {}
    for i, text in docs:
        t = text.replace("\n", " ") + ("、「日本。」!!" if i % 4 == 0 else "A1!?2" if i % 4 == 1 else "。12")
        width, room = (60.0 + i % 240) * 1.3, (40.0 + i * 7 % 400) * 1.5
        cs = [c for run in re.findall(r"[0-9A-Za-z!?]+|[^0-9A-Za-z!?]", t) for c in ([run] if 2 <= len(run) <= 4 else run)]
        capacity = lambda s: max(1, int(room / (s * 1.05)) - 3)  # noqa: B023, E731
        size = next((s for s in range(min(int(room), 60), 8, -1) if math.ceil(len(cs) / capacity(s)) * 1.1 * s <= width), 9)
        size = max(9, math.floor(size * 0.85 + 0.5))
        cols = []
        for c in cs:
            n = len(cols[-1]) if cols else 0
            if cols and (n < capacity(size) or n < capacity(size) + 2 and len(c) == 1 and c in L.NO_START):
                cols[-1].append(c)
            else:
                cols.append([c])
        cells[i], fit[i], columns[i], placed[i] = (len(cs), "|".join(cs)), (size, capacity(size)), "|".join(map("".join, cols)), len(cs)

        def lines(s):
            out, most = [""], max(width - 3 * s, s)  # noqa: B023
            for c in t:  # noqa: B023
                if out[-1] and measure(out[-1] + c) * s > most and c not in L.NO_START:
                    out.append("")
                out[-1] += c
            return out

        measure = lambda x: sum(1.0 if L.WIDE.match(c) else 0.5 for c in x)
        fits = lambda s: len(ls := lines(s)) * s * 1.18 <= room and max(map(measure, ls)) * s <= width  # noqa: B023, E731
        if len(t) < 300:
            s = next((s for s in range(min(int(room), 60), 8, -1) if fits(s)), 9)
            s = max(9, math.floor(s * 0.85 + 0.5))
            wrapped[i] = (s, "|".join(lines(s)))
    assert {r[0]: r[1:] for r in rows(spark, "vertical_cells", str(tmp_path))} == cells
    assert {r[0]: r[1:] for r in rows(spark, "vertical_fit", str(tmp_path))} == fit and (9, 1) not in fit.values()
    assert {r[0]: r[1] for r in rows(spark, "kinsoku_columns", str(tmp_path))} == columns
    counted = {}
    for r in rows(spark, "cell_placement", str(tmp_path)):
        counted[r[0]] = counted.get(r[0], 0) + 1
    assert counted == placed
    got = {r[0]: r[1:] for r in rows(spark, "horizontal_wrap", str(tmp_path))}
    assert {i: got[i] for i in wrapped} == wrapped and {s for s, _ in wrapped.values()} > {9}
    assert all(got[i][1].replace("|", "") == t.replace("\n", " ") + got[i][1].replace("|", "")[len(t):] for i, t in docs)
