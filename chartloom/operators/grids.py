"""Cells of images: connected components by runs, small ones removed; skeletons as paths between keypoints, by tiles and pointer doubling.

Cells are rows (by..., x, y), `by` naming the image and whatever else keeps cells apart. No image is gathered: every step is a join or an
aggregate over all images at once, or looks at one tile, so one huge image spreads over the cluster like many small ones. Repeated cells count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.graphs import connected_components
from chartloom.sources.scratch import Scratch, cut

#: Columns of an image that are joined at once.
BLOCK = 256
#: Rows and blocks of an image whose touching runs are contracted by one task.
STRIP, BLOCKS = 256, 16
#: Side of a tile, whose paths are found where it lies, a power of two of 16 at least; the first one's begins at minus half of that. Blocks of 8 by 8 cells that are looked at together.
TILE, LOT = 256, 1 << 14
#: The eight neighbours of a cell.
AROUND = tuple((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy)


def runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., y, x0, x1, run): the maximal runs of cells along each row, numbered; a written table."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    islands = cells.select(*by, "y", "x").distinct().withColumn("_i", F.col("x") - F.row_number().over(w))
    return cut(islands.groupBy(*by, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i").withColumn("run", F.monotonically_increasing_id()))


def labelled(cells: DataFrame, by: list[str]) -> DataFrame:
    """runs() with `component`, the same for runs that touch, corners included.

    A run meets those of the next row that share one of its blocks of columns, so runs of wide rows are not all compared.
    """
    found = runs(cells, by)
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col("x0") - a) / BLOCK), F.floor((F.col("x1") + b) / BLOCK))).alias("block")
    upper = found.select(*by, "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("a"), span(0, 0))
    lower = found.select(*by, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run").alias("b"), span(1, 1))
    touch = upper.join(lower, [*by, "y", "block"]).where("a0 <= b1 + 1 AND b0 <= a1 + 1")
    touch = touch.select(*by, F.floor(F.col("y") / STRIP).alias("_s"), F.floor(F.col("block") / BLOCKS).alias("_b"), "a", "b").repartition(*by, "_s", "_b").sortWithinPartitions(*by, "_s", "_b").select("a", "b")
    parts = connected_components(touch).withColumnRenamed("id", "run")
    return found.join(parts, "run", "left").withColumn("component", F.coalesce("component", "run"))


def components(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., component, area, x0, y0, x1, y1, x_sum, y_sum) of each component."""
    n = F.col("x1") - F.col("x0") + 1
    return labelled(cells, by).groupBy(*by, "component").agg(
        F.sum(n).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("x_sum"), F.sum(F.col("y") * n).alias("y_sum")
    )


def without_small(cells: DataFrame, by: list[str], least: int) -> DataFrame:
    """The cells of components of at least `least` cells."""
    found = cut(labelled(cells, by))
    large = found.groupBy("component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).where(F.col("area") >= least)
    return found.join(large, "component", "left_semi").select(*by, F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def steps(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x, y, nx, ny, degree): each cell with each of its neighbours, and how many of them it has. A cell without any has a row with none."""
    # a row's cells stand by blocks of columns, those beside a block in it, too; each row meets those above and below it
    column = lambda dx: F.floor((F.col("x") + dx) / BLOCK)
    rows = cells.select(*by, "x", "y", F.explode(F.array_distinct(F.array(*(column(dx) for dx in (-1, 0, 1))))).alias("block")).groupBy(*by, "y", "block").agg(F.collect_set("x").alias("xs"))
    met = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), (F.col("y") - dy).alias("y")) for dy in (-1, 0, 1)))).alias("_at"), "block", "xs").select(*by, "_at.*", "block", "xs")
    three = met.groupBy(*by, "y", "block").agg(*(F.max(F.when(F.col("dy") == dy, F.col("xs"))).alias(f"_{dy + 1}") for dy in (-1, 0, 1)))
    own = three.select(*by, F.explode("_1").alias("x"), "y", "block", "_0", "_1", "_2").where(column(0) == F.col("block"))
    near = F.array_compact(F.array(*(F.when(F.array_contains(F.col(f"_{dy + 1}"), F.col("x") + dx), F.struct((F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny"))) for dx, dy in AROUND)))
    return own.select(*by, "x", "y", near.alias("_near")).select(*by, "x", "y", F.size("_near").cast("long").alias("degree"), F.explode_outer("_near").alias("n")).select(*by, "x", "y", "degree", "n.nx", "n.ny")


def _tiles(cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of cells (by..., ty, tx, oy, ox, by_, bx, bits) in their tile: those of images that cross no tile's edge, and of those that do, if any, also in each tile that they are less than three cells from.

    A block of 8 by 8 cells is one number, so what is shuffled is far less than cells.
    """
    known = cells.dropna(subset=[*by, "x", "y"]).select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    near = " OR ".join(f"(({c} + {TILE // 2}) & {TILE - 1}) IN (0, 1, {TILE - 2}, {TILE - 1})" for c in "xy")
    wide = cut(known.where(near).select(*by).distinct())
    blocks = known.selectExpr(*(f"`{c}`" for c in by), "shiftright(y, 3) AS by_", "shiftright(x, 3) AS bx", "shiftleft(1L, CAST((y & 7) * 8 + (x & 7) AS INT)) AS bit").groupBy(*by, "by_", "bx").agg(F.bit_or("bit").alias("bits"))
    size, half = TILE // 8, TILE // 16
    tile = lambda c, d: F.shiftright(F.col(c) + half + d, size.bit_length() - 1)
    at = lambda dy, dx: F.struct(tile("by_", dy).alias("ty"), tile("bx", dx).alias("tx"))
    dealt = lambda rows, of: rows.select(*by, F.explode(of).alias("_t"), "by_", "bx", "bits").select(*by, "_t.*", "by_", "bx", "bits").repartition(*by, "ty", "tx").sortWithinPartitions(*by, "ty", "tx")
    if not wide.head(1):
        return dealt(blocks, F.array(at(0, 0))), None
    around = F.array_distinct(F.array(*(at(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    return dealt(blocks.join(wide, by, "left_anti"), F.array(at(0, 0))), dealt(blocks.join(wide, by, "left_semi"), around)


def _walks(head: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps from each head on, till none follows: (walk, place in it, step) of all, and how many each has."""
    now, who, k, out = head, np.arange(len(head)), 0, []
    n = np.zeros(len(head), np.int64)
    while len(now):
        out.append((who, np.full(len(now), k), now))
        n[who] += 1
        now = follows[now]
        who, now, k = who[now >= 0], now[now >= 0], k + 1
    walk, place, step = (np.concatenate([np.zeros(0, np.int64), *(x[j] for x in out)]) for j in range(3))
    return walk, place, step, n


def _tile_paths(size: int, group: np.ndarray, ty: np.ndarray, tx: np.ndarray, by_: np.ndarray, bx: np.ndarray, bits: np.ndarray):
    """Paths and rings that lie whole in their tile, and the steps of all others.

    (group, y and x of path's u and v, degrees at its ends, cells' offsets, y, x), then (group, y and x of u and v, degree, into).
    """
    row, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    y, x = by_[row] * 8 + (bit >> 3), bx[row] * 8 + (bit & 7)
    # from the tile's corner; two cells beyond it tell degrees of those next to it
    ly, lx = y - (ty[row] * size - size // 2), x - (tx[row] * size - size // 2)
    seen = (ly >= -2) & (ly < size + 2) & (lx >= -2) & (lx < size + 2)
    side = size + 8
    code = (group[row] * side + ly + 4) * side + lx + 4
    order = np.argsort(code[seen], kind="stable")
    code, g, y, x, ly, lx = (c[seen][order] for c in (code, group[row], y, x, ly, lx))
    inside = (ly >= 0) & (ly < size) & (lx >= 0) & (lx < size)
    n = len(code)
    a, b = [], []
    for d in (1, side - 1, side, side + 1):
        at = np.searchsorted(code, code + d)
        i = np.flatnonzero(code[np.minimum(at, n - 1)] == code + d)
        a.append(i), b.append(at[i])
    a, b = np.concatenate(a), np.concatenate(b)
    u, v = np.concatenate((a, b)), np.concatenate((b, a))
    degree = np.bincount(u, minlength=n)
    order = np.argsort(u * n + v)  # so a cell's steps stand together, in order of y, x
    u, v = u[order], v[order]
    begin = np.searchsorted(u, np.arange(n))
    own = inside[u]
    follows = np.full(len(u), -1)
    on = np.flatnonzero(own & inside[v] & (degree[v] == 2))
    first = begin[v[on]]
    follows[on] = first + (v[first] == u[on])
    after = np.zeros(len(u), bool)
    after[follows[on]] = True
    head = np.flatnonzero(own & ~after)
    walk, place, step, steps_ = _walks(head, follows)
    last = np.zeros(len(head), np.int64)
    last[walk[place == steps_[walk] - 1]] = step[place == steps_[walk] - 1]
    whole = (degree[u[head]] != 2) & (degree[v[last]] != 2) & inside[v[last]]
    left = np.sort(step[~whole[walk]])
    # both directions are whole; the one that begins smaller names the path
    taken = whole & (u[head] * n + v[head] <= v[last] * n + u[last])
    # what no walk met goes round: a ring begins at its smallest cell, towards the smaller neighbour
    met = ~own
    met[step] = True
    ring = np.flatnonzero(~met)
    place_of = np.zeros(len(u), np.int64)
    place_of[ring] = np.arange(len(ring))
    low, to = u[ring], place_of[follows[ring]] if len(ring) else ring
    for _ in range(len(ring).bit_length()):
        low, to = np.minimum(low, low[to]), to[to]
    start = ring[u[ring] == low]
    start = start[np.concatenate((np.ones(min(len(start), 1), bool), u[start][1:] != u[start][:-1]))]
    closing = ring[np.isin(follows[ring], start)]
    follows[closing] = -1
    walk2, place2, step2, steps2 = _walks(start, follows)
    # cells of all paths, one after the other, each with the last step's end
    number = np.cumsum(taken) - 1
    keep = taken[walk]
    walk = np.concatenate((number[walk[keep]], walk2 + taken.sum()))
    place, step, length = np.concatenate((place[keep], place2)), np.concatenate((step[keep], step2)), np.concatenate((steps_[taken], steps2)) + 1
    offset = np.concatenate(([0], np.cumsum(length)))
    cell = np.zeros(offset[-1], np.int64)
    cell[offset[walk] + place] = u[step]
    end = place == length[walk] - 2
    cell[offset[walk[end]] + place[end] + 1] = v[step[end]]
    from_, to_ = np.concatenate((u[head[taken]], u[start])), np.concatenate((v[head[taken]], u[start]))
    tip = np.concatenate((v[last[taken]], u[start]))
    paths = (g[from_], y[from_], x[from_], y[to_], x[to_], degree[from_], degree[tip], offset, y[cell], x[cell])
    return paths, (g[u[left]], y[u[left]], x[u[left]], y[v[left]], x[v[left]], degree[u[left]], degree[v[left]])


def _found(by: int, names: list[str], size: int, lot: int):
    """For mapInArrow over dealt blocks: the rows of _tile_paths, lots of whole tiles at a time."""

    def rows(t: pa.Table):
        t = t.combine_chunks()
        new = np.zeros(len(t), bool)
        for k in range(by + 2):
            c = t.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(t) - 1)).to_numpy().astype(bool)
        group, first = np.cumsum(new), np.concatenate(([0], np.flatnonzero(new)))
        (g, *ends, offset, y, x), (g2, *arcs) = _tile_paths(size, group, *(t.column(by + k).to_numpy() for k in range(5)))
        lists = [pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(c, pa.int64())) for c in (y, x)]
        for of, whole, numbers, more in ((g, True, ends, lists), (g2, False, arcs, [pa.nulls(len(g2), lists[0].type)] * 2)):
            keys = t.select(range(by)).take(pa.array(first[of]))
            cols = [*keys.columns, pa.array(np.full(len(of), whole)), *(pa.array(c, pa.int64()) for c in numbers), *more]
            yield pa.Table.from_arrays(cols, names=names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < lot:
                continue
            t = pa.Table.from_batches(held)
            # the last tile may go on
            end = np.zeros(n, bool)
            for k in range(by + 2):
                c = t.column(k)
                end |= pc.not_equal(c, c[n - 1]).to_numpy().astype(bool)
            m = int(np.flatnonzero(end)[-1]) + 1 if end.any() else 0
            if m:
                for out in rows(t.slice(0, m)):
                    yield from out.to_batches()
            held, n = t.slice(m).to_batches(), n - m
        if n:
            for out in rows(pa.Table.from_batches(held)):
                yield from out.to_batches()

    return run


def _by_tiles(dealt: DataFrame, by: list[str]) -> DataFrame:
    """(by..., whole, path, first, last, ys, xs) of paths that lie in one tile; of others each step, under path, with its cells' degrees."""
    names = ["uy", "ux", "vy", "vx", "first", "last"]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*by).schema), "whole boolean", *(f"{c} long" for c in names), "ys array<long>", "xs array<long>"])
    found = dealt.mapInArrow(_found(len(by), [*by, "whole", *names, "ys", "xs"], TILE, LOT), kinds)
    point = lambda c: F.struct(F.col(f"{c}y").alias("y"), F.col(f"{c}x").alias("x"))
    return found.select(*by, "whole", F.struct(point("u").alias("u"), point("v").alias("v")).alias("path"), "first", "last", "ys", "xs")


def _split(cells: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Paths that lie in one tile, a row each (by..., path, length, ends, ys, xs), and the cells of all others (by..., path, pos, cell, length, ends), if there are any."""
    narrow, wide = _tiles(cells, by)
    row = lambda d: d.where("whole").select(*by, "path", F.size("xs").cast("long").alias("length"), F.struct("first", "last").alias("ends"), "ys", "xs")
    if wide is None:
        return row(_by_tiles(narrow, by)), None
    found = cut(_by_tiles(wide, by))
    arcs = found.where("NOT whole").select(*by, "path.*", F.col("first").alias("degree"), F.col("last").alias("into"))
    return row(_by_tiles(narrow, by)).unionByName(row(found)), _doubled(arcs, by)


def path_ends(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., path, a, b, length, ends, x_sum) of each path of traced(): its first and last cells (x, y), and the sum of its cells' x. No path that lies in one tile is shuffled."""
    whole, others = _split(cells, by)
    at = lambda k: F.struct(F.element_at("xs", k).alias("x"), F.element_at("ys", k).alias("y"))
    out = whole.select(*by, "path", at(1).alias("a"), at(-1).alias("b"), "length", "ends", F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x).alias("x_sum"))
    if others is None:
        return out
    cell = F.struct(F.col("cell.x").alias("x"), F.col("cell.y").alias("y"))
    more = others.groupBy(*by, "path").agg(F.min_by(cell, "pos").alias("a"), F.max_by(cell, "pos").alias("b"), F.first("length").alias("length"), F.first("ends").alias("ends"), F.sum("cell.x").alias("x_sum"))
    return out.unionByName(more)


def traced(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., path, pos, x, y, length, ends): the paths of a skeleton, cell by cell.

    A path runs from keypoint to keypoint, cells that have not just two neighbours, through cells that have two; its ends are
    their degrees. It begins at its smaller end (y, x, then the next cell's), length is its number of cells. Rings without a
    keypoint begin and end at their smallest cell.

    Paths that lie in one tile are walked there; the steps of others, of images that cross a tile's edge, are joined by pointer doubling.
    """
    whole, others = _split(cells, by)
    out = whole.select(*by, "path", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "_c"), "length", "ends").select(*by, "path", F.col("pos").cast("long").alias("pos"), F.col("_c.xs").alias("x"), F.col("_c.ys").alias("y"), "length", "ends")
    if others is None:
        return out
    return out.unionByName(others.select(*by, "path", "pos", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "length", "ends"))


def _doubled(arcs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., path, pos, cell, length, ends) from the steps (by..., u, v, degree, into) of whole paths.

    A step u -> v into a cell of two neighbours goes on with v -> w. Each step points to the one that follows; pointers
    double until they reach the step that ends their path, which takes log2 of the longest path rounds, whatever its image. The
    distance to the end places every step.
    """
    # the step that follows u -> v is v -> w with w other than u; a step into a keypoint ends its path
    on = arcs.where("degree = 2").select(*by, F.col("u").alias("v"), F.col("v").alias("w"))
    follow = arcs.where("into = 2").join(on, [*by, "v"]).where("w <> u").select(*by, "u", "v", F.struct(F.col("v").alias("u"), F.col("w").alias("v")).alias("to"))
    now = cut(arcs.join(follow, [*by, "u", "v"], "left").select(*by, "u", "v", "degree", "into", F.coalesce("to", F.struct("u", "v")).alias("to"), F.col("to").isNotNull().cast("long").alias("d"), F.least("u", "v").alias("low"), F.col("to").isNull().alias("done")))
    left, before, ended = now.where("NOT done").count(), None, now.where("done").drop("still")
    while left:
        # on a ring nothing ends: once its pointers have gone round, its smallest cell is known and nothing changes any more
        open_ = now.where("NOT done")
        ahead = ended.unionByName(open_.select(ended.columns)).select(*by, F.struct("u", "v").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        moved = open_.join(ahead, [*by, "to"]).select(*by, "u", "v", "degree", "into", "to2", (F.col("d") + F.col("d2")).alias("d"), F.least("low", "low2").alias("low"), "done2", (F.col("low") == F.least("low", "low2")).alias("still"))
        now = cut(moved.select(*by, "u", "v", "degree", "into", F.col("to2").alias("to"), "d", "low", F.col("done2").alias("done"), "still"))
        ended = ended.unionByName(now.where("done").drop("still"))  # what has ended is not written again
        before, (left, moving) = left, now.where("NOT done").agg(F.count("*"), F.count_if(~F.col("still"))).head()
        if left == before and not moving:
            break
    return _paths(ended, by).unionByName(_rings(now.where("NOT done"), by))


def _paths(steps_: DataFrame, by: list[str]) -> DataFrame:
    """Steps that end at a keypoint: `to` is the last step, d how many steps are left."""
    # both directions of a path meet in its first and last steps; the smaller one names it
    first = steps_.where("degree <> 2").select(*by, F.struct("u", "v").alias("begin"), F.col("to").alias("final"), "d", "degree")
    back = F.struct(F.col("final.v").alias("u"), F.col("final.u").alias("v"))
    ends = first.withColumn("back", back).where("begin <= back")
    last = steps_.where("into <> 2").select(*by, F.struct("u", "v").alias("final"), F.col("into").alias("last_degree"))
    named = ends.join(last, [*by, "final"]).select(*by, F.col("final").alias("to"), F.col("begin").alias("path"), (F.col("d") + 2).alias("length"), F.struct(F.col("degree").alias("first"), F.col("last_degree").alias("last")).alias("ends"), F.col("d").alias("all"))
    placed = steps_.join(named, [*by, "to"]).withColumn("pos", F.col("all") - F.col("d"))
    cells = placed.select(*by, "path", "length", "ends", "pos", F.col("u").alias("cell"))
    tail = placed.where("d = 0").select(*by, "path", "length", "ends", (F.col("pos") + 1).alias("pos"), F.col("v").alias("cell"))
    return cells.unionByName(tail)


def _rings(steps_: DataFrame, by: list[str]) -> DataFrame:
    """Rings: rank by doubling over the ring cut open at its smallest cell, in the direction of that cell's smaller neighbour."""
    scratch = Scratch()
    opened = steps_.where("u = low").groupBy(*by, "low").agg(F.min("v").alias("second"))
    plain = steps_.select(*by, "u", "v", "low")
    begin = plain.join(opened, [*by, "low"]).where("u = low AND v = second")
    nxt = plain.select(*by, F.col("u").alias("v"), F.col("v").alias("w"), "low")
    arcs = plain.join(nxt, [*by, "low", "v"]).where("w <> u")
    # ranks from the start: a step knows the step 2**k before it until it knows the start
    now = arcs.select(*by, "low", F.struct("u", "v").alias("from"), F.struct(F.col("v").alias("u"), F.col("w").alias("v")).alias("at")).join(begin.select(*by, F.struct("u", "v").alias("at"), F.lit(True).alias("start")), [*by, "at"], "left")
    now = cut(now.select(*by, "low", "at", F.when(F.col("start"), F.lit(None)).otherwise(F.col("from")).alias("from"), F.when(F.col("start"), F.lit(0)).otherwise(1).cast("long").alias("d"), F.coalesce("start", F.lit(False)).alias("start"), F.lit(False).alias("reached")), scratch)
    now_ = now.withColumn("reached", F.col("start"))
    before = None
    while True:
        ahead = now_.select(*by, F.col("at").alias("from"), F.col("from").alias("from2"), F.col("d").alias("d2"), F.col("reached").alias("reached2"))
        step = now_.join(ahead, [*by, "from"], "left")
        moved = step.select(*by, "low", "at", F.when(F.col("reached"), F.lit(None)).otherwise(F.col("from2")).alias("from"), F.when(F.col("reached"), F.col("d")).otherwise(F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), "start", (F.col("reached") | F.coalesce("reached2", F.lit(False))).alias("reached"))
        last, now = now, cut(moved, scratch)
        scratch.drop(last)
        now_ = now
        n = now.where("reached").count()
        if n == before:
            break
        before = n
    mine = now.where("reached")
    size = mine.groupBy(*by, "low").agg(F.count("*").alias("n"))
    cells = mine.join(size, [*by, "low"]).select(*by, F.struct(F.col("low").alias("u"), F.col("low").alias("v")).alias("path"), (F.col("n") + 1).alias("length"), F.struct(F.lit(2).cast("long").alias("first"), F.lit(2).cast("long").alias("last")).alias("ends"), F.col("d").alias("pos"), F.col("at.u").alias("cell"))
    return cells.unionByName(cells.where("pos = 0").withColumn("pos", F.col("length") - 1))


def without_spurs(cells: DataFrame, by: list[str], longest: int) -> DataFrame:
    """The cells that stay when paths of up to `longest` cells between an endpoint and a junction go; the junction stays."""
    paths = traced(cells, by)
    spur = (F.least("ends.first", "ends.last") == 1) & (F.greatest("ends.first", "ends.last") > 2) & (F.col("length") <= longest)
    junction = F.when(F.col("pos") == 0, F.col("ends.first") > 2).when(F.col("pos") == F.col("length") - 1, F.col("ends.last") > 2).otherwise(False)
    gone = paths.where(spur & ~junction).select(*by, "x", "y")
    return cells.select(*by, "x", "y").distinct().join(gone, [*by, "x", "y"], "left_anti")
