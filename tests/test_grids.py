"""Components and paths of cells against walks in Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from chartloom.operators import graphs, grids
from chartloom.sources.scratch import cut

AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def near(c, cells):
    return [(c[0] + dx, c[1] + dy) for dx, dy in AROUND if (c[0] + dx, c[1] + dy) in cells]


def parts(cells):
    todo, out = set(cells), []
    while todo:
        stack, part = [todo.pop()], set()
        while stack:
            c = stack.pop()
            part.add(c)
            for n in near(c, cells):
                if n in todo:
                    todo.discard(n)
                    stack.append(n)
        out.append(frozenset(part))
    return out


def images():
    rng = np.random.default_rng(2)
    out = {k: {(int(x), int(y)) for x, y in rng.integers(0, 24, (n, 2))} for k, n in enumerate((0, 1, 40, 130, 250, 500))}
    out[10] = {(x, 0) for x in range(600)} | {(x, 2) for x in range(600)} | {(599, 1)}  # wide rows, met at one end
    out[11] = {(k, k) for k in range(-5, 30)} | {(-k, k + 40) for k in range(9)}
    return out


def test_components_are_those_of_a_walk(spark):
    made = images()
    rows = [(k, x, y) for k, cells in made.items() for x, y in cells]
    cells = spark.createDataFrame(rows + rows[:50], "image int, x long, y long")
    got = Counter((r.image, r.area, r.x0, r.y0, r.x1, r.y1, r.x_sum, r.y_sum) for r in grids.components(cells, ["image"]).collect())
    box = lambda p: (len(p), min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p), sum(x for x, _ in p), sum(y for _, y in p))
    assert got == Counter((k, *box(p)) for k, c in made.items() for p in parts(c))
    for least in (1, 3, 8):
        kept = {(r.image, r.x, r.y) for r in grids.without_small(cells, ["image"], least).collect()}
        assert kept == {(k, x, y) for k, c in made.items() for p in parts(c) if len(p) >= least for x, y in p}
    assert grids.components(cells.limit(0), ["image"]).count() == 0


def walks(cells):
    """Paths between keypoints and rings, each as its cells in order."""
    next_to = {c: near(c, cells) for c in cells}
    key = lambda c: (c[1], c[0])
    out, used = [], set()
    for c in sorted(cells, key=key):
        if len(next_to[c]) == 2 or not next_to[c]:
            continue
        for n in next_to[c]:
            path = [c, n]
            while len(next_to[path[-1]]) == 2:
                path.append(next(x for x in next_to[path[-1]] if x != path[-2]))
            used |= set(path)
            begin, back = (key(path[0]), key(path[1])), (key(path[-1]), key(path[-2]))
            if begin <= back:
                out.append((path, (len(next_to[path[0]]), len(next_to[path[-1]]))))
    for c in sorted((c for c in cells if len(next_to[c]) == 2), key=key):
        if c not in used:
            path = [c, min(next_to[c], key=key)]
            while path[-1] != c:
                path.append(next(x for x in next_to[path[-1]] if x != path[-2]))
            used |= set(path)
            out.append((path, (2, 2)))
    return out


def skeletons():
    ring = {(x, 0) for x in range(1, 8)} | {(x, 8) for x in range(1, 8)} | {(0, y) for y in range(1, 8)} | {(8, y) for y in range(1, 8)}
    line = {(x, 20) for x in range(300)}
    combed = {(x, 30) for x in range(40)} | {(x, 30 + d) for x in range(4, 36, 6) for d in range(1, 2 + x % 5)}
    far = {(x + 100, y + 50) for x, y in ring}
    return {0: ring, 1: line, 2: combed | {(60, 60)}, 3: ring | line | far | {(9, 40), (10, 40)}, 4: {(x, y) for x, y in images()[2]}, 5: images()[3], 6: {(0, 0)}}


def test_traced_paths_are_those_of_a_walk(spark):
    made = skeletons()
    cells = spark.createDataFrame([(k, x, y) for k, c in made.items() for x, y in c], "image int, x long, y long")
    found = {}
    for r in grids.traced(cells, ["image"]).collect():
        found.setdefault((r.image, r.path), ([], (r.ends.first, r.ends.last), r.length))[0].append((r.pos, (r.x, r.y)))
    got = Counter((k, tuple(c for _, c in sorted(cells)), ends) for (k, _), (cells, ends, _) in found.items())
    assert all(len(c) == n and sorted(p for p, _ in c) == list(range(n)) for c, _, n in found.values())
    assert got == Counter((k, tuple(p), ends) for k, c in made.items() for p, ends in walks(c))


@pytest.mark.parametrize("longest", [2, 4])
def test_spurs_go_and_junctions_stay(spark, longest):
    made = skeletons()
    cells = spark.createDataFrame([(k, x, y) for k, c in made.items() for x, y in c], "image int, x long, y long")
    want = set()
    for k, c in made.items():
        gone = set()
        for p, (a, b) in walks(c):
            if min(a, b) == 1 and max(a, b) > 2 and len(p) <= longest:
                gone |= set(p) - {p[0] if a > 2 else p[-1]}
        want |= {(k, *x) for x in c - gone}
    assert {(r.image, r.x, r.y) for r in grids.without_spurs(cells, ["image"], longest).collect()} == want


def test_lots_of_edges_become_stars():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 900, (2, 700)) * 10**12 - 10**14
    got = dict(zip(*(x.tolist() for x in graphs.stars(a, b)), strict=True))
    root = {x: x for x in (*a.tolist(), *b.tolist())}
    for _ in range(900):
        before = dict(root)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[x] = root[y] = min(root[x], root[y])
        if before == root:
            break
    assert got == {x: r for x, r in root.items() if x != r}


def test_a_contracted_graph_takes_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graphs, "cut", lambda df, scratch=None: written.append(1) or cut(df, scratch))
    edges = spark.createDataFrame([(k, k + 1) for k in range(400) if k % 50], "a long, b long").coalesce(1)
    got = {r.id: r.component for r in graphs.connected_components(edges).collect()}
    assert got == {k: (k - 1) // 50 * 50 + 1 for k in range(1, 401)}
    assert len(written) == 1  # a path of fifty took rounds of shuffles before


def test_steps_meet_over_blocks_of_columns(spark, monkeypatch):
    monkeypatch.setattr(grids, "BLOCK", 4)
    rng = np.random.default_rng(8)
    cells = {(int(x), int(y)) for x, y in rng.integers(-9, 9, (120, 2))}
    got = grids.steps(spark.createDataFrame([(1, *c) for c in [*cells, *list(cells)[:9]]], "image int, x long, y long"), ["image"]).collect()
    want = {(x, y, x + dx, y + dy) for x, y in cells for dx, dy in grids.AROUND if (x + dx, y + dy) in cells}
    assert {tuple(r)[1:3] + (r.nx, r.ny) for r in got if r.nx is not None} == want and len(got) == len(want) + sum(not any((x + dx, y + dy) in cells for dx, dy in grids.AROUND) for x, y in cells)
    assert all(r.degree == sum((r.x, r.y) == w[:2] for w in want) for r in got)


def ends_of(p, ends):
    return p[0], p[-1], len(p), ends, sum(x for x, _ in p)


def test_paths_in_one_tile_are_neither_written_nor_doubled(spark, monkeypatch):
    made = {**skeletons(), 1: {(x, 20) for x in range(100)}}
    del made[3]
    rows = [(k, x, y) for k, c in made.items() for x, y in c if x < 120 and y < 120]
    written = []
    monkeypatch.setattr(grids, "cut", lambda df, scratch=None: written.append(df.count()) or cut(df, scratch))
    cells = spark.createDataFrame(rows + rows[:60] + [(None, 1, 1), (1, None, 1)], "image int, x long, y long")
    got = Counter((r.image, (tuple(r.a), tuple(r.b), r.length, tuple(r.ends), r.x_sum)) for r in grids.path_ends(cells, ["image"]).collect())
    assert got == Counter((k, ends_of(p, ends)) for k, c in made.items() for p, ends in walks({q for q in c if q[0] < 120 and q[1] < 120}))
    assert sum(written) == 0  # all steps before


def test_paths_over_tiles_are_those_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(grids, "TILE", 16)
    monkeypatch.setattr(grids, "LOT", 5)
    rng = np.random.default_rng(4)
    made = {**skeletons(), 7: {(int(x), int(y)) for x, y in rng.integers(-20, 20, (420, 2))}, 8: {(3, 3), (4, 4)}}
    shift = {k: (int(rng.integers(-40, 40)), int(rng.integers(-40, 40))) for k in made}
    made = {k: {(x + shift[k][0], y + shift[k][1]) for x, y in c} for k, c in made.items()}
    cells = spark.createDataFrame([(k, f"k{k}", x, y) for k, c in made.items() for x, y in c], "image int, name string, x long, y long")
    found = {}
    for r in grids.traced(cells, ["image", "name"]).collect():
        found.setdefault((r.image, r.path), ([], (r.ends.first, r.ends.last), r.length))[0].append((r.pos, (r.x, r.y)))
    got = Counter((k, tuple(c for _, c in sorted(cells)), ends) for (k, _), (cells, ends, _) in found.items())
    assert all(len(c) == n and sorted(p for p, _ in c) == list(range(n)) for c, _, n in found.values())
    assert got == Counter((k, tuple(p), ends) for k, c in made.items() for p, ends in walks(c))
    ends = Counter((r.image, (tuple(r.a), tuple(r.b), r.length, tuple(r.ends), r.x_sum)) for r in grids.path_ends(cells, ["image", "name"]).collect())
    assert ends == Counter((k, ends_of(p, e)) for k, c in made.items() for p, e in walks(c))
