"""Mask heads against direct sums over whole images."""

import math

import numpy as np
import pytest

from pagewright.operators import heads as H
from pagewright.operators.images import resize_bilinear

RNG = np.random.default_rng(3)


def test_dynamic_mask_equals_direct_sums():
    kernel, features = RNG.normal(size=169), RNG.normal(size=(5, 7, 8))
    logit = np.zeros((5, 7))
    for y in range(5):
        for x in range(7):
            a = [(24 - 8 * x) / 128, (16 - 8 * y) / 128, *features[y, x]]
            b = [max(0, kernel[152 + o] + sum(kernel[10 * o + i] * a[i] for i in range(10))) for o in range(8)]
            c = [max(0, kernel[160 + o] + sum(kernel[80 + 8 * o + i] * b[i] for i in range(8))) for o in range(8)]
            logit[y, x] = kernel[168] + sum(kernel[144 + i] * c[i] for i in range(8))
    got = H.dynamic_mask(kernel, features, 24, 16, 16)
    assert got.shape == (40, 56) and np.allclose(got, 1 / (1 + np.exp(-resize_bilinear(logit, 40, 56))))
    with pytest.raises(ValueError):
        H.dynamic_mask(kernel[:-1], features, 0, 0, 8)


def test_sigmoid_of_large_numbers():
    with np.errstate(all="raise", under="ignore"):
        assert H.sigmoid(np.array([-1e4, 0.0, 1e4])).tolist() == [0.0, 0.5, 1.0]


def test_prototype_part_equals_whole_images():
    prototypes = RNG.normal(size=(16, 16, 4))
    seen = 0
    for _ in range(200):
        coefficients = RNG.normal(size=4) * 3
        box = *RNG.uniform(-5, 70, 2), *RNG.uniform(0, 40, 2)
        inner = int(RNG.integers(0, 20)), int(RNG.integers(0, 20)), int(RNG.integers(8, 40)), int(RNG.integers(8, 40))
        inner = inner[0], inner[1], min(inner[2], 64 - inner[0]), min(inner[3], 64 - inner[1])
        target = int(RNG.integers(5, 90)), int(RNG.integers(5, 90))
        x0, x1, y0, y1 = (f((c + s * n / 2) / 4) for c, n in ((box[0], box[2]), (box[1], box[3])) for f, s in ((math.floor, -1), (math.ceil, 1)))
        p = np.zeros((16, 16))
        for y in range(max(0, y0), min(16, y1)):
            for x in range(max(0, x0), min(16, x1)):
                p[y, x] = 1 / (1 + math.exp(-prototypes[y, x] @ coefficients))
        square = resize_bilinear(p, 64, 64)[inner[0] : inner[0] + inner[2], inner[1] : inner[1] + inner[3]]
        want = resize_bilinear(square, *target) > 0.5
        got, found = np.zeros(target, bool), H.prototype_part(prototypes, coefficients, box, 64, inner, target)
        if found:
            part, (y, x) = found
            got[y : y + part.shape[0], x : x + part.shape[1]] = part
        assert (got == want).all()
        seen += want.any() and not want.all()
    assert seen > 30


def test_pages_without_instances(spark):
    rows = [(1, 2, 2, [0.0] * 32, 16, 16, 3, 4, None), (2, 2, 2, [0.0] * 32, 16, 16, 3, 4, [])]
    fields = "page long, height int, width int, values array<double>, inner_h int, inner_w int, page_h int, page_w int, instances array<struct<x:double,y:double,stride:int,score:double,kernel:array<double>>>"
    assert {(r["page"], len(r["mask"]), any(r["mask"])) for r in H.dynamic_masks(spark.createDataFrame(rows, fields)).collect()} == {(1, 12, False), (2, 12, False)}
    rows = [(1, 2, 2, [0.0] * 32, 0, 0, 8, 8, 3, 4, None), (2, 2, 2, [9.0] * 32, 0, 0, 8, 8, 3, 4, [(40.0, 40.0, 4.0, 4.0, [1.0] * 8)]), (3, 2, 2, [9.0] * 32, 0, 0, 8, 8, 3, 4, [(4.0, 4.0, 8.0, 8.0, [1.0] * 8)])]
    fields = "page long, height int, width int, values array<double>, top int, left int, inner_h int, inner_w int, page_h int, page_w int, instances array<struct<cx:double,cy:double,w:double,h:double,coefficients:array<double>>>"
    assert {(r["page"], sum(r["mask"])) for r in H.prototype_masks(spark.createDataFrame(rows, fields), 8).collect()} == {(1, 0), (2, 0), (3, 12)}
