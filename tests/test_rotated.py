"""Suppression of rotated boxes against a plain loop whose overlap comes from hulls of corners and crossings."""

import math
from collections import defaultdict

import numpy as np
import pytest

from framewright import catalogue
from framewright.operators import detection as D
from framewright.queries.boxes import detections

SF = "/root/testdata/sf0.001"


def corners(x, y, w, h, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(x + a * w / 2 * c - b * h / 2 * s, y + a * w / 2 * s + b * h / 2 * c) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def inside(p, poly):
    side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(poly, poly[1:] + poly[:1])]
    return all(v >= -1e-9 for v in side)


def crossings(p, q):
    out = []
    for a, b in zip(p, p[1:] + p[:1]):
        for c, d in zip(q, q[1:] + q[:1]):
            det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if abs(det) < 1e-12:
                continue
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
            u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / det
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def shared(a, b):
    p, q = corners(*a), corners(*b)
    points = [x for x in p if inside(x, q)] + [x for x in q if inside(x, p)] + crossings(p, q)
    if len(points) < 3:
        return 0.0
    mx, my = sum(x for x, _ in points) / len(points), sum(y for _, y in points) / len(points)
    ring = sorted(points, key=lambda v: math.atan2(v[1] - my, v[0] - mx))
    return abs(sum(u[0] * v[1] - u[1] * v[0] for u, v in zip(ring, ring[1:] + ring[:1]))) / 2


def test_rotated_suppression_equals_a_plain_loop(spark):
    groups = defaultdict(list)
    for r in detections(spark, SF).collect():
        b = r.box
        groups[r.image, r["class"]].append((-r.score, r.id, ((b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, b.x1 - b.x0, b.y1 - b.y0, r.id * 15 % 90)))
    want = set()
    for key, own in groups.items():
        kept = []
        for _, i, b in sorted(own):
            if all((s := shared(b, k)) / (b[2] * b[3] + k[2] * k[3] - s) <= 0.3 for k in kept):
                kept.append(b)
                want.add((*key, i))
    got = {(r.image, r["class"], r.id) for r in catalogue.QUERIES["g7_suppress_rotated"](spark, SF).collect()}
    assert got == want and len(want) < sum(map(len, groups.values()))
    assert shared((0, 0, 2, 2, 0), (0, 0, 2, 2, 45)) == pytest.approx(8 * (math.sqrt(2) - 1))


def test_many_images_are_compared_at_once():
    calls = []
    overlap = lambda a, b: calls.append(len(a)) or D._iou_matrix(a, b)
    boxes = np.tile(np.array([[0, 0, 10, 10], [1, 0, 11, 10], [50, 0, 60, 10]], float), (1000, 1))
    of = D._kept(boxes, np.arange(0, 3001, 3), overlap, lambda v: v > 0.5)
    assert (of.reshape(-1, 3) - np.arange(0, 3000, 3)[:, None] == [0, 0, 2]).all() and calls == [3000]
    other = np.array([[5.0, 0.0, 10.0, 4.0, 90.0]] * 3)
    assert D.rotated_iou(np.array([5.0, 0.0, 4.0, 10.0, 0.0]), other) == pytest.approx([1.0] * 3)
