"""Colour clusters and their segments against Python."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from test_grids import parts

from chartloom.operators import colours


def plain(pixels, k, rounds, seed):
    count = Counter(c for _, _, c in pixels if None not in c)
    cents = sorted(count, key=lambda c: hashlib.md5(":".join(map(str, (seed, *c))).encode()).hexdigest())[:k]
    near = lambda c: min((sum((a - b) ** 2 for a, b in zip(c, m, strict=True)), i) for i, m in enumerate(cents))[1]
    for _ in range(rounds):
        own = {c: near(c) for c in count}
        for i in range(len(cents)):
            n = sum(count[c] for c in own if own[c] == i)
            if n:
                cents[i] = tuple(sum(c[x] * count[c] for c in own if own[c] == i) // n for x in range(3))
    return {c: (near(c), cents[near(c)]) for c in count}


def images():
    rng = np.random.default_rng(3)
    out = {}
    for k in range(3):
        cells = {}
        for x in range(40):
            for y in range(30):
                base = (250, 250, 250) if x % 10 > 6 or y < 3 else [(200, 30, 30), (30, 200, 60), (20, 40, 220), (5, 5, 5), (100, 100, 105)][(x // 10 + k + (y > 20)) % 5]
                cells[x, y] = tuple(int(min(255, max(0, c + d))) for c, d in zip(base, rng.integers(-4, 5, 3), strict=True))
        out[k] = [(x, y, c) for (x, y), c in cells.items()]
    out[1].append((60, 60, (None, 3, 4)))
    out[7] = [(0, 0, (9, 200, 9)), (1, 0, (9, 200, 9)), (5, 5, (200, 9, 9))]
    return out


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 2)])
def test_clusters_and_segments(spark, k, rounds):
    made = images()
    rows = [(i, x, y, *c) for i, p in made.items() for x, y, c in p]
    pixels = spark.createDataFrame(rows, "image int, x long, y long, r int, g int, b int")
    want = {i: plain(p, k, rounds, 42) for i, p in made.items()}
    got = {(r.image, (r.r, r.g, r.b)): (r.cluster, (r.cr, r.cg, r.cb)) for r in colours.palette(pixels, "image", k, rounds).collect()}
    assert got == {(i, c): v for i, m in want.items() for c, v in m.items()}
    ground = lambda r, g, b: min(r, g, b) > 240 or max(r, g, b) < 15 or (abs(b - g) < 20 and abs(g - r) < 20 and b < 200)
    expected = Counter()
    for i, p in made.items():
        for cluster in {v for v in want[i].values() if not ground(*v[1])}:
            for part in parts({(x, y) for x, y, c in p if c in want[i] and want[i][c] == cluster}):
                if len(part) >= 2:
                    xs, ys = zip(*part, strict=True)
                    expected[i, cluster[0], *cluster[1], len(part), min(xs), min(ys), max(xs), max(ys), sum(xs) // len(xs), sum(ys) // len(ys)] += 1
    found = colours.segments(pixels, "image", k, rounds, least=2)
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert all(0.1 <= (r.x1 - r.x0 + 1) / (r.y1 - r.y0 + 1) <= 5 for r in colours.bars(found).collect())
    for r in colours.slices(found, 640, 400).collect():
        assert r.radius == 180 and r.angle_end - r.angle_start == pytest.approx(2 * r.area / 180**2) and r.angle_start == pytest.approx(math.atan2(r.cy - 200, r.cx - 320))
