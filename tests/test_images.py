"""Detector maps, letterboxes, strips, hooks and files on small cases with known results."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import hooks, images, providers, regions
from pagewright.operators.images import DetectorConfig
from pagewright.sources import files


def block(spark, ratio=1.0, page_w=64, page_h=32):
    v = np.full((32, 64), -10.0)
    v[10:20, 10:40] = 2.0
    return spark.createDataFrame([(1, 32, 64, v.ravel().tolist(), ratio, page_w, page_h)], "page long, height int, width int, values array<double>, ratio double, page_w int, page_h int")


def found(spark, config=DetectorConfig(), **kw):
    return [(np.array(r["quad"]).reshape(4, 2), r["score"]) for r in images.detect_lines(block(spark, **kw), config).collect()]


def test_detector_configuration(spark):
    (quad, score), = found(spark)
    assert abs(score - 1 / (1 + math.exp(-2))) < 1e-9 and len(quad) == 4
    assert not found(spark, DetectorConfig(box_threshold=0.9)) and not found(spark, DetectorConfig(bin_threshold=0.9)) and not found(spark, DetectorConfig(min_side=50))
    assert len(found(spark, DetectorConfig(min_side=5))) == 1
    width = lambda q: np.ptp(q[:, 0])
    tight, loose = (found(spark, DetectorConfig(unclip_ratio=k), page_w=1000, page_h=1000)[0][0] for k in (1.0, 3.0))
    assert width(loose) > width(tight) + 1
    full, half = (found(spark, ratio=k, page_w=1000, page_h=1000)[0][0] for k in (1.0, 0.5))
    assert np.allclose(full * 2, half)
    small = found(spark, DetectorConfig(unclip_ratio=3.0), page_w=30, page_h=15)[0][0]
    assert (small >= 0).all() and (small[:, 0] <= 30).all() and (small[:, 1] <= 15).all()


def test_resizing_equals_direct_sums():
    img = np.random.default_rng(1).integers(0, 256, (9, 13)).astype(float)
    got = images.resize_area(img, 4, 5)
    for y in range(4):
        for x in range(5):
            a, b, c, d = y * 9 / 4, (y + 1) * 9 / 4, x * 13 / 5, (x + 1) * 13 / 5
            w = [[max(0, min(b, j + 1) - max(a, j)) * max(0, min(d, i + 1) - max(c, i)) for i in range(13)] for j in range(9)]
            assert abs(got[y, x] - (np.array(w) * img).sum() / np.sum(w)) < 1e-9
    assert np.allclose(images.resize_bilinear(img, 9, 13), img)
    seg = np.zeros((8, 8))
    seg[:4, :4] = 0.5
    assert images.page_mask(seg, 0.5, 8, 8).all() and not images.page_mask(seg * 0.2, 0.5, 8, 8).any()


def test_letterboxes():
    rgb = np.zeros((20, 10, 3))
    rgb[..., 0] = 200
    chw, nh, nw = images.letterbox_corner(rgb, 8, (1, 2, 3), (2, 2, 2), 114)
    assert (nh, nw) == (8, 4) and chw[2, 0, 0] == (200 - 3) / 2 and chw[0, 0, 0] == -0.5 and chw[1, 0, 7] == 56
    chw, nh, nw, top, left = images.letterbox_centre(rgb, 8, 114)
    assert (nh, nw, top, left) == (8, 4, 0, 2) and chw[0, 3, 3] == 200 / 255 and chw[2, 3, 0] == 114 / 255


def test_strips(spark):
    img = np.add.outer(np.arange(30) * 3, np.arange(40) * 2).astype(float)
    assert np.allclose(images.warp_strip(img, [(5, 4), (14, 4), (14, 9), (5, 9)], 10, 6), img[4:10, 5:15])
    assert np.allclose(images.cubic(np.array([0.0, 1.0, 2.0, -0.5])), [1, 0, 0, 0.59375])
    rows = [(1, 30, 40, img.ravel().tolist(), [[float(c) for c in q] for q in ((5, 4, 35, 4, 35, 14, 5, 14), (3, 2, 9, 2, 9, 26, 3, 26), (1, 1, 1, 1, 1, 1, 1, 1))])]
    got = images.cut_strips(spark.createDataFrame(rows, "page long, height int, width int, values array<double>, quads array<array<double>>")).collect()
    assert [(r["line"], r["height"], r["width"], len(r["values"])) for r in got] == [(0, 48, 144, 48 * 144), (1, 48, 192, 48 * 192)]


def test_greedy_matches():
    a = [(0, 0, 10, 10), (1, 0, 11, 10), (50, 50, 60, 60)]
    assert images.match_boxes(a, [(1, 0, 11, 10), (0, 0, 10, 10), (50, 50, 80, 80)]) == [(0, 1), (1, 0)]


def png(img, kind):
    h, w = img.shape
    body = b""
    for y in range(h):
        row, up = img[y].astype(int), img[y - 1].astype(int) if y else np.zeros(w, int)
        left, corner = np.append(0, row[:-1]), np.append(0, up[:-1])
        p = left + up - corner
        near = np.stack([left, up, corner])
        guess = [0, left, up, (left + up) // 2, near[np.abs(p - near).argmin(0), np.arange(w)]][kind]
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    return files.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_files(spark, tmp_path):
    img = np.random.default_rng(2).integers(0, 256, (6, 7)).astype(np.uint8)
    for kind in range(5):
        assert (files.decode_png(png(img, kind)) == img).all()
        (tmp_path / f"p{kind}.png").write_bytes(png(img, kind))
    (tmp_path / "bad.png").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_pages(spark, str(tmp_path / "*.png")).collect()}
    assert len(got) == 6 and got["bad.png"]["error"] and got["p4.png"]["values"] == img.ravel().tolist() and got["p0.png"]["height"] == 6
    for half in (True, False):
        (tmp_path / "t.bin").write_bytes(np.array([1.5, -2, 65504], "<f2" if half else "<f4").tobytes())
        assert files.read_tensors(spark, str(tmp_path / "t.bin"), half).first()["values"] == [1.5, -2, 65504]
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.0)], "page long, text string, score double")
    files.write_regions(df, str(tmp_path / "regions"))
    assert sorted(files.read_regions(spark, str(tmp_path / "regions"), df.schema.simpleString()[7:-1].replace(":", " ")).collect()) == sorted(df.collect())


def test_hooks(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "x"), (3, 1, None)], "page long, i long, source string")

    def up(texts):
        if texts == ["x"]:
            raise RuntimeError("down")
        return texts + [""] if texts == [""] else [t.upper() for t in texts]

    got = {(r["page"], r["i"]): (r["translated"], r["error"]) for r in hooks.translate_pages(rows, up, lambda c: F.concat(c, F.lit("!"))).collect()}
    assert got == {(1, 1): ("A!", None), (1, 2): ("B!", None), (2, 1): (None, "RuntimeError: down"), (3, 1): (None, "2/1")}
    assert hooks.translate_pages(rows, None).where("translated <=> source").count() == 4
    t = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0])], "key long, img array<float>")
    out = {r["key"]: r for r in hooks.run_model(t, lambda x: {"y": x["img"].sum(0)}, {"img": (2, 2)}, {"y": (2,)}).collect()}
    assert out[1]["y"] == [4.0, 6.0] and out[2]["y"] is None and "do not fit" in out[2]["error"]
    m = spark.createDataFrame([(1, [1, 200], [True, False])], "page long, values array<int>, mask array<boolean>")
    assert hooks.union_masks(m, lambda v: [x > 100 for x in v]).first()["mask"] == [True, True]
    assert hooks.run_stages(rows, None, lambda d: d.where("page = 1")).count() == 2
    tiers = spark.createDataFrame([(1, "L2", "x"), (1, "L3", "y")], "page long, tier string, data string")
    assert sorted(r["receipt"] for r in hooks.to_sink(tiers, lambda r: r["tier"] + r["data"]).collect()) == ["L2x", "L3y"]


def test_retry_remembers_refusals(spark):
    rows = spark.createDataFrame([(1, "a|m"), (2, "b|m")], "id long, retry_key string")
    send = lambda df: df.withColumn("refused", (F.col("retry_key") == "a|m") & ~F.col("drop_thinking"))
    out, keys = providers.with_retry(rows, send)
    assert sorted((r["id"], r["drop_thinking"]) for r in out.collect()) == [(1, True), (2, False)] and [r[0] for r in keys.collect()] == ["a|m"]
    out, _ = providers.with_retry(rows, send, keys)
    assert sorted((r["id"], r["drop_thinking"]) for r in out.collect()) == [(1, True), (2, False)]


@pytest.mark.parametrize(("text", "want"), [("日", True), ("ア", True), ("！", True), ("abc é", False), ("", False)])
def test_cjk(spark, text, want):
    assert spark.range(1).select(regions.is_cjk(F.lit(text))).first()[0] is want


def test_an_invalid_pattern_is_no_rule(spark):
    from pagewright.operators import protocol

    df = spark.createDataFrame([("a", "b")], "s string, t string")
    assert df.select(protocol.filtered(F.col("s"), F.col("t"), "(")).first()[0] is False


def test_repeated_requests_are_kept(spark):
    rules = spark.createDataFrame(providers.RULES, providers.RULE_SCHEMA)
    rows = spark.createDataFrame([(1, "alpha", "r1"), (1, "alpha", "r1"), (1, None, None)], "id long, provider string, model string")
    assert providers.rule_lookup(rows, rules).count() == 3
