"""Curves and moments against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.operators import curves


def menger(a, b, c):
    ab, bc, ca = (math.dist(p, q) for p, q in ((a, b), (b, c), (c, a)))
    return 0.0 if min(ab, bc, ca) < 1e-10 else 2 * abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / (ab * bc * ca)


def kept(points, eps):
    keep = {0, len(points) - 1}

    def split(a, b):
        size = math.dist(points[a], points[b])
        if b - a <= 1 or size < 1e-10:
            return
        best, at = 0.0, a
        for k in range(a + 1, b):
            p, q, r = (np.array(points[i], float) for i in (a, b, k))
            along = np.dot(r - p, q - p) / size
            d = math.dist(r, p) if along < 0 else math.dist(r, q) if along > size else math.dist(r, p + along * (q - p) / size)
            ratio = d / eps[k] if eps[k] > 0 else d
            if ratio > best:
                best, at = ratio, k
        if best > 1:
            keep.add(at)
            split(a, at), split(at, b)

    split(0, len(points) - 1)
    return keep


def frame(spark, paths):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, pts in paths.items() for i, (x, y) in enumerate(pts)], "path long, pos long, x double, y double")


def test_splits_are_those_of_recursion(spark):
    rng = np.random.default_rng(4)
    paths = {k: np.cumsum(rng.integers(-3, 4, (n, 2)), 0).tolist() for k, n in enumerate((1, 2, 3, 12, 60, 200))}
    paths[10] = [(math.cos(t / 9) * 30 + t * 0.31, math.sin(t / 9) * 17 + t * t * 0.0013) for t in range(57)]  # no ties in rounding
    paths[11] = [(0, 0), (5, 5), (0, 0)]
    paths[12] = [(k, 0) for k in range(30)]
    points = frame(spark, paths)
    want = set()
    for k, p in paths.items():
        n = len(p)
        bend = [menger(p[max(0, i - 3)], p[i], p[min(n - 1, i + 3)]) for i in range(n)]
        want |= {(k, i) for i in kept(p, [0.5 if c > 0.1 else 5.0 - 4.5 * c / 0.1 for c in bend])}
    assert {(r.path, r.pos) for r in curves.simplified_by_curvature(points, "path").collect()} == want
    flat = {(k, i) for k, p in paths.items() for i in kept(p, [1.0] * len(p))}
    rows = curves.split_points(points.withColumn("eps", F.lit(1.0)), "path", "eps").collect()
    assert {(r.path, r.pos) for r in rows} == flat and len(rows) == len(flat)


def shapes():
    turn = lambda p, t: (p[0] * math.cos(t) - p[1] * math.sin(t), p[0] * math.sin(t) + p[1] * math.cos(t))
    around = lambda n, a, b, low=0.0, high=2 * math.pi: [(a * math.cos(low + (high - low) * k / n), b * math.sin(low + (high - low) * k / n)) for k in range(n)]
    move = lambda pts, x, y, t=0.0: [(turn(p, t)[0] + x, turn(p, t)[1] + y) for p in pts]
    rng = np.random.default_rng(1)
    return {
        1: move(around(40, 4, 4), 100, 50), 2: move(around(20, 5, 5, 0.3, 2.0), -20, 7), 3: move(around(60, 8, 2), 30, 30, 0.4), 4: [(k, 2 * k) for k in range(25)],
        5: rng.normal(0, 3, (40, 2)).tolist(), 6: [(0, 0), (1, 5), (2, 0)], 7: move(around(30, 4, 4, 2.5, 4.5), 0, 0), 8: [(1, 1)] * 12, 9: move(around(24, 3, 6), 5, -9, 1.2),
    }


def test_kinds_fits_and_arcs(spark):
    made = shapes()
    points = frame(spark, made)
    kinds = {r.path: r.kind for r in curves.curve_kinds(points, "path").collect()}
    assert kinds == {1: "circle", 2: "arc", 3: "ellipse", 4: "line", 5: kinds[5], 6: "line", 7: "circle", 8: "line", 9: "ellipse"} and kinds[5] in ("spline", "ellipse")
    oval = {r.path: r for r in curves.ellipses(points, "path").collect()}
    for k, (x, y, a, b) in {1: (100, 50, 4, 4), 3: (30, 30, 8, 2), 9: (5, -9, 6, 3)}.items():
        r = oval[k]
        assert (r.cx, r.cy) == pytest.approx((x, y)) and sorted((r.a, r.b), reverse=True) == pytest.approx([a, b]) and r.fit == pytest.approx(1)
        if k == 3:
            assert (r.angle if r.a > r.b else r.angle + 90) % 180 == pytest.approx(math.degrees(0.4))
    assert 4 not in oval and 8 not in oval and 6 not in oval
    circles = curves.fitted_circles(points, "path")
    found = {r.path: r for r in circles.collect()}
    for k, p in made.items():
        if k in (4, 8):
            assert k not in found
            continue
        x, y = np.array(p, float).T
        (cx, cy, c), *_ = np.linalg.lstsq(np.column_stack((2 * x, 2 * y, np.ones(len(x)))), x**2 + y**2, rcond=None)
        assert (found[k].cx, found[k].cy, found[k].radius) == pytest.approx((cx, cy, math.sqrt(c + cx**2 + cy**2)))
    arcs = {r.path: (r.start, r.end) for r in curves.arc_angles(points, circles, "path").collect()}
    assert arcs[2] == pytest.approx((0.3, 0.3 + 1.7 * 19 / 20)) and arcs[7] == pytest.approx((2.5, 2.5 + 2 * 29 / 30 - 2 * math.pi))


def test_moments_and_refinement(spark):
    rng = np.random.default_rng(7)
    image = rng.integers(0, 50, (12, 15)).astype(float)
    yy, xx = np.mgrid[:12, :15]
    peak = 100 * np.exp(-((xx - 7.3) ** 2 + (yy - 5.6) ** 2) / 8)
    images = {1: image, 2: image.T, 3: image[::-1, ::-1], 4: peak, 5: np.zeros((3, 3))}
    rows = [(k, x, y, float(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    pixels = spark.createDataFrame(rows, "image long, x long, y long, v double")
    got = {r.image: r for r in curves.image_moments(pixels, "image").collect()}
    assert set(got) == {1, 2, 3, 4}
    hu = lambda r: [r[f"h{k}"] for k in range(1, 8)]
    assert hu(got[1])[:6] == pytest.approx(hu(got[2])[:6], rel=1e-6, abs=1e-18) and hu(got[1]) == pytest.approx(hu(got[3]), rel=1e-6, abs=1e-18)  # turned and mirrored
    assert abs(hu(got[1])[6]) == pytest.approx(abs(hu(got[2])[6]), abs=1e-18)
    m = image / image.sum()
    cx, cy = (m * np.arange(15)).sum(), (m * np.arange(12)[:, None]).sum()
    cov = np.array([[(m * (np.arange(15) - cx) ** 2).sum(), (m * np.outer(np.arange(12) - cy, np.arange(15) - cx)).sum()], [0, (m * (np.arange(12)[:, None] - cy) ** 2).sum()]])
    cov[1, 0] = cov[0, 1]
    low, high = np.linalg.eigvalsh(cov)
    assert (got[1].cx, got[1].cy, got[1].elongation) == pytest.approx((cx, cy, min(10, math.sqrt(high / low)) / 10))

    def sobel(a, axis):
        k = np.outer([1, 2, 1], [-1, 0, 1]) if axis else np.outer([-1, 0, 1], [1, 2, 1])
        return np.array([[(a[r : r + 3, c : c + 3] * k).sum() for c in range(a.shape[1] - 2)] for r in range(a.shape[0] - 2)])

    spots = [(1, 0, 6.2, 5.0), (1, 1, 1.0, 5.0), (4, 2, 7.0, 6.0), (4, 3, 14.0, 11.0), (2, 4, 5.0, 7.0), (9, 5, 3.0, 3.0)]
    moved = {r.vertex: (r.x, r.y) for r in curves.refined(spark.createDataFrame(spots, "image long, vertex long, x double, y double"), pixels, "image").collect()}
    for k, v, x, y in spots:
        a, i, j = images.get(k), round(x), round(y)
        want = (x, y)
        if a is not None and 2 <= i < a.shape[1] - 2 and 2 <= j < a.shape[0] - 2:
            win = a[j - 2 : j + 3, i - 2 : i + 3]
            gx, gy = sobel(win, 1), sobel(win, 0)
            hx, hy = sobel(gx, 1)[0, 0], sobel(gy, 0)[0, 0]
            want = x + np.clip(-gx[1, 1] / hx, -2, 2), y + np.clip(-gy[1, 1] / hy, -2, 2)
        assert moved[v] == pytest.approx(want)
    assert 7.0 < moved[2][0] < 7.3 and 5.6 < moved[2][1] < 6.0  # nearer to the peak; smoothed second differences shorten the step
