"""Golden pages and small cases with known results."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.functions import compat
from pagewright.operators import grouping as G
from pagewright.operators import layout, probe, protocol, raster, sequence

PAGES = json.loads((Path(__file__).parent / "fixtures/grouping_pages.json").read_text())


@pytest.mark.parametrize("page", sorted(PAGES))
def test_golden_pages(page):
    got = sorted([r["x0"], r["y0"], r["x1"], r["y1"], r["angle"]] for r in G.group_page(PAGES[page]["lines"]))
    want = sorted(PAGES[page]["regions"])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert max(abs(x - y) for x, y in zip(a[:4], b[:4], strict=True)) <= 2 and abs(a[4] - b[4]) <= 1


def test_geometry():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert G.area(square) == 100 and G.area([(0, 0), (10, 0), (0, 10)]) == 50
    assert G.point_segment((5, 3), (0, 0), (10, 0)) == 3 and G.point_segment((14, 0), (0, 0), (10, 0)) == 4
    assert G.polygon_distance(square, [(13, 0), (20, 0), (20, 10), (13, 10)]) == 3
    assert G.polygon_distance(square, [(5, 5), (15, 5), (15, 15), (5, 15)]) == 0
    assert len(G.hull([*square, (5, 5), (5, 0)])) == 4
    assert sorted(G.min_area_rect([(0, 0), (20, 0), (20, 10), (0, 10)])[4:]) == [10, 20]


def test_grouping_basics():
    line = lambda x, y, w=100, h=20: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    assert len(G.group_page([line(0, 0)])) == 1
    assert len(G.group_page([line(0, 0), line(0, 25)])) == 1
    assert len(G.group_page([line(0, 0), line(0, 25), line(0, 50)])) == 1
    assert len(G.group_page([line(0, 0), line(500, 900)])) == 2


@pytest.mark.parametrize(("src", "dst", "want"), [(5, 5, [0, 1, 2, 3, 4]), (10, 4, [0, 2, 5, 7]), (4, 10, [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]), (4, 5, [0, 0, 1, 2, 3])])
def test_nearest_index(spark, src, dst, want):
    assert [r[0] for r in spark.range(dst).orderBy("id").select(raster.nearest_index(F.col("id"), src, dst)).collect()] == want


def test_mask_fits_page(spark):
    rows = [(1000, 1500, 1000, 1500, True), (2401, 3201, 1201, 1601, True), (1500, 1000, 1000, 1500, False), (1000, 1520, 1000, 1500, False), (0, 0, 0, 0, False)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", raster.fits_page(*[F.col(x) for x in "abcd"]).alias("got")).collect())


def test_text_rules(spark):
    df = spark.createDataFrame([("　x\t",), ("１２",), ("Ⅷ",), ("  ",)], "t string")
    got = df.select(compat.utrim(F.col("t")), compat.all_digits(F.col("t")), compat.blank(F.col("t")), compat.half_up(F.lit(-2.5))).collect()
    assert [tuple(r) for r in got] == [("x", False, False, -2), ("１２", True, False, -2), ("Ⅷ", False, False, -2), ("", False, True, -2)]
    keep = spark.createDataFrame([("a", "b", True), ("a", " ", False), ("a", "123", False), ("Same", "same", False), ("a", "SFX x", False)], "s string, t string, keep boolean")
    assert all(r["keep"] != r["bad"] for r in keep.select("keep", protocol.filtered(F.col("s"), F.col("t"), "^SFX").alias("bad")).collect())


def test_replies(spark):
    reply = "<think>x <|9|>no</think><|1|>one\r\n<2|> two\n<3 >|baz\n<|2|>again\nnoise\n<|99999999999|>big"
    got = {r["id"]: r["text"] for r in protocol.parse_replies(spark.createDataFrame([(1, reply)], "page long, reply string")).collect()}
    assert got == {1: "one", 2: "again", 3: "baz", None: "big"}


def test_ctc(spark):
    steps = [(1, t, i, math.log(0.5)) for t, i in enumerate([0, 2, 2, 0, 2, 3, 3])]
    alphabet = spark.createDataFrame([(2, "a"), (3, "b")], "idx int, symbol string")
    out = sequence.ctc_text(spark.createDataFrame([*steps, (2, 0, 0, -1.0)], "strip long, t int, idx int, logp double"), alphabet)
    got = {r["strip"]: (r["text"], round(r["prob"], 9)) for r in out.collect()}
    assert got == {1: ("aab", 0.5), 2: ("", 0.0)}


def test_layout(spark):
    one = spark.range(1)
    cells = lambda t: one.select(layout.vertical_cells(F.lit(t))).first()[0]
    assert cells("日12本ABCDE!?5") == ["日", "12", "本", *"ABCDE!?5"]
    cols = one.select(layout.columns(F.array(*[F.lit(c) for c in "ab、、、cd"]), F.lit(2))).first()[0]
    assert cols == [["a", "b", "、", "、"], ["、", "c"], ["d"]]


def test_log_lines(spark):
    lines = spark.createDataFrame([(1, 1, "PAIR\tthreads=1\tpage=2\tcompared=3\tmismatches=0"), (1, 2, "PAIR\tthreads=1\tpage=2\tcompared=3\tmismatches=5"), (1, 3, "PAIR\tthre"), (1, 4, "X")], "run long, line_no long, line string")
    got = probe.pairs(probe.parse(lines)).first()
    assert (got["pairs"], got["compared"], got["mismatches"]) == (2, 1, 0)


def test_resampling_needs_whole_images(spark):
    cells = [(img, y, x, 10 * y + x) for img in (1, 2) for y in range(2) for x in range(2)]
    fields = "img int, y int, x int, v int"
    got = raster.resample_bilinear(spark.createDataFrame(cells, fields), 2, 1).collect()
    assert sorted((r["img"], r["y"], r["x"], r["v"]) for r in got) == [(1, 0, 0, 5.5), (2, 0, 0, 5.5)]
    assert raster.resample_nearest(spark.createDataFrame([], fields), 2, 3).count() == 0
    for wrong in (cells[:-1], cells + cells[:1]):
        with pytest.raises(Exception, match="not whole"):
            raster.resample_nearest(spark.createDataFrame(wrong, fields), 2, 3).collect()


@pytest.mark.parametrize("seed", range(4))
def test_sweep_and_tree_equal_all_pairs(seed):
    draw = random.Random(seed)
    lines = []
    for _ in range(60):
        x, y, w, h = draw.randrange(200), draw.randrange(200), draw.choice([4, 12, 40]), draw.choice([4, 12, 40])
        lean = draw.choice([0, 0, 3])
        lines.append(G.Line([(x + lean, y), (x + w + lean, y + lean), (x + w, y + h + lean), (x, y + h)]))
    pairs = {(i, j) for i in range(60) for j in range(i + 1, 60) if G.may_merge(lines[i], lines[j])}
    assert pairs and set(G.merges(lines)) == pairs
    members, tree = list(range(seed, 60, 2)), []
    for e in sorted((G.line_distance(lines[a], lines[b]), a, b) for a in members for b in members if a < b):
        if len(G.components(60, [x[1:] for x in [*tree, e]])) < len(G.components(60, [x[1:] for x in tree])):
            tree.append(e)
    assert G.spanning_tree(lines, members) == tree
