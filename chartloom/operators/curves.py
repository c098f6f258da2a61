"""Curves from points: tolerances that follow curvature, splits at the farthest point, arcs, ellipses, and which curve a path is.

Points are rows (path, pos, x, y). No path is gathered into a row: neighbours come from windows, fits from sums of moments, and a
path is split by rounds in which every open stretch finds its farthest point at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.sources.scratch import Scratch, cut

#: Tolerances in curved and straight stretches, the curvature from which a stretch is curved, neighbours on either side.
TIGHT, LOOSE, CURVED, HALF = 0.5, 5.0, 0.1, 3
#: Points below which a path is a line, and the fit from which a curve is taken.
FEWEST, GOOD = 10, 0.95


def _menger(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], factor: float) -> Column:
    side = lambda p, q: F.hypot(p[0] - q[0], p[1] - q[1])
    ab, bc, ca = side(a, b), side(b, c), side(c, a)
    cross = F.abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    return F.when((ab < 1e-10) | (bc < 1e-10) | (ca < 1e-10), 0.0).otherwise(factor * cross / (ab * bc * ca))


def with_curvature(points: DataFrame, path: str, half: int = HALF) -> DataFrame:
    """points with `curvature`: four times the area over the product of sides, of each point and those `half` before and behind it, the path's ends where it has no more."""
    w = Window.partitionBy(path).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = lambda c: F.coalesce(F.lag(c, half).over(w), F.first(c).over(whole))
    on = lambda c: F.coalesce(F.lead(c, half).over(w), F.last(c).over(whole))
    x, y = F.col("x"), F.col("y")
    return points.withColumn("curvature", _menger((back("x"), back("y")), (x, y), (on("x"), on("y")), 2.0))


def tolerance(curvature: Column) -> Column:
    """TIGHT where a path is curved, nearer to LOOSE the straighter it is."""
    return F.when(curvature > CURVED, TIGHT).otherwise(LOOSE - (LOOSE - TIGHT) * curvature / CURVED)


def split_points(points: DataFrame, path: str, eps: str) -> DataFrame:
    """(path, pos) of the points that stay: both ends, and where a stretch has points beyond their own tolerance (column `eps`), the one farthest in proportion, from which it is split in two.

    Distance is that from the stretch's chord, from its ends beyond them; of equal ones the first counts. A stretch whose ends
    coincide is not split. The driver sees one count a round.
    """
    scratch = Scratch()
    at = lambda n: F.struct(F.col("pos").alias("pos"), F.col("x").alias("x"), F.col("y").alias("y")).alias(n)
    ends = points.groupBy(path).agg(F.min(at("p")).alias("a"), F.max(at("p")).alias("b"))
    todo = cut(points.select(path, "pos", "x", "y", F.col(eps).alias("eps")).join(ends, path).where("pos > a.pos AND pos < b.pos"), scratch)
    kept = cut(ends.select(path, F.explode(F.array_distinct(F.array("a.pos", "b.pos"))).alias("pos")))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    size = F.hypot(dx, dy)
    along = ((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / size
    from_a, from_b = F.hypot(F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")), F.hypot(F.col("x") - F.col("b.x"), F.col("y") - F.col("b.y"))
    off = F.hypot(F.col("x") - F.col("a.x") - along * dx / size, F.col("y") - F.col("a.y") - along * dy / size)
    dist = F.when(along < 0, from_a).when(along > size, from_b).otherwise(off)
    ratio = F.when(F.col("eps") > 0, dist / F.col("eps")).otherwise(dist)
    while True:
        open_ = todo.where(size >= 1e-10).withColumn("ratio", ratio)
        far = open_.where("ratio > 1").groupBy(path, F.col("a.pos").alias("from")).agg(F.min(F.struct((-F.col("ratio")).alias("r"), "pos", "x", "y")).alias("m"))
        far = cut(far.select(path, "from", F.struct("m.pos", "m.x", "m.y").alias("m")), scratch)
        if not far.head(1):
            break
        kept = kept.unionByName(cut(far.select(path, F.col("m.pos").alias("pos"))))
        met = todo.join(far.withColumnRenamed(path, "_path"), (F.col(path) == F.col("_path")) & (F.col("a.pos") == F.col("from"))).where("pos <> m.pos")
        first = F.col("pos") < F.col("m.pos")
        last, todo = todo, cut(met.select(path, "pos", "x", "y", "eps", F.when(first, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(first, F.col("m")).otherwise(F.col("b")).alias("b")), scratch)
        scratch.drop(last, far)
    return kept


def simplified_by_curvature(points: DataFrame, path: str) -> DataFrame:
    """split_points() with a tolerance for each point that follows its curvature."""
    return split_points(with_curvature(points, path).withColumn("eps", tolerance(F.col("curvature"))), path, "eps")


def fitted_circles(points: DataFrame, path: str) -> DataFrame:
    """(path, n, cx, cy, radius, fit) of each path of three points or more that no line holds: least squares of x**2 + y**2 about their mean, from sums.

    fit is one less the squares of (squared distance - radius**2) over those about their own mean, 1 where both vanish.
    """
    return _about_circles(points, path).where("radius IS NOT NULL").groupBy(path).agg(*_circle()).select(path, "n", "cx", "cy", "radius", _fit().alias("fit"))


def _about_means(points: DataFrame, path: str) -> DataFrame:
    """points of paths that are not null with n, mx, my, scale of their path, and u, v from its mean: one sort by path, no join."""
    w = Window.partitionBy(path)
    m = points.where(F.col(path).isNotNull()).withColumns({"n": F.count("*").over(w), "mx": F.avg("x").over(w), "my": F.avg("y").over(w), "scale": F.sqrt(F.var_pop("x").over(w) + F.var_pop("y").over(w))})
    return m.withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))


def _about_circles(points: DataFrame, path: str) -> DataFrame:
    """_about_means() with cx, cy, radius of the path's circle, null where it has none, and d, a point's squared distance from the centre."""
    w = Window.partitionBy(path)
    c = _about_means(points, path)
    z = F.col("u") * F.col("u") + F.col("v") * F.col("v")
    total = lambda *cs: F.sum(math.prod(cs[1:], start=cs[0])).over(w)
    s = c.withColumns({"uu": total(F.col("u"), F.col("u")), "vv": total(F.col("v"), F.col("v")), "uv": total(F.col("u"), F.col("v")), "zu": total(z, F.col("u")), "zv": total(z, F.col("v"))})
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a, b = F.try_divide(F.col("zu") * F.col("vv") - F.col("zv") * F.col("uv"), 2 * det), F.try_divide(F.col("zv") * F.col("uu") - F.col("zu") * F.col("uv"), 2 * det)
    sure = (F.col("n") >= 3) & (det > 1e-9 * (F.col("uu") + F.col("vv")) ** 2)
    circle = s.select(*c.columns, F.when(sure, F.col("mx") + a).alias("cx"), F.when(sure, F.col("my") + b).alias("cy"), F.when(sure, F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))).alias("radius"))
    return circle.withColumn("d", (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)


def _circle() -> list[Column]:
    """What a path's rows of _about_circles() give of its circle; _fit() follows from them."""
    return [*(F.first(c).alias(c) for c in ("n", "cx", "cy", "radius")), F.sum((F.col("d") - F.col("radius") ** 2) ** 2).alias("res"), (F.var_pop("d") * F.count("*")).alias("tot")]


def _fit() -> Column:
    return F.when(F.col("tot") < 1e-10, F.when(F.col("res") < 1e-10, 1.0).otherwise(0.0)).otherwise(1 - F.col("res") / F.col("tot"))


def arc_angles(points: DataFrame, circles: DataFrame, path: str) -> DataFrame:
    """(path, start, end) of the arc that a path's points cover on its circle, across the angle of pi where the widest gap lies elsewhere."""
    a = points.join(circles, path).withColumn("t", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    w = Window.partitionBy(path).orderBy("t")
    gap = a.select(path, "t", F.lead("t").over(w).alias("next")).withColumn("gap", F.col("next") - F.col("t"))
    by = gap.groupBy(path).agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("gap").alias("widest"), F.max_by(F.struct("t", "next"), F.struct("gap", -F.col("t"))).alias("at"))
    across = F.coalesce(F.col("widest") > math.pi, F.lit(False))
    return by.select(path, F.when(across, F.col("at.next")).otherwise(F.col("low")).alias("start"), F.when(across, F.col("at.t")).otherwise(F.col("high")).alias("end"))


def ellipses(points: DataFrame, path: str) -> DataFrame:
    """(path, cx, cy, a, b, angle, fit): the conic a u**2 + b uv + c v**2 + d u + e v = 1 of least squares about each path's mean, where it is an ellipse.

    Its 5 by 5 normal equations are sums of products of the terms, scaled by the path's spread; only these sums, 20 a path, are solved in Arrow batches.
    a is the semi-axis at `angle` degrees, b the other; fit is one less the mean of |(r / r of the ellipse)**2 - 1|, 0 at least.
    """
    c = _about_means(points, path).where("n >= 5 AND scale > 1e-9")
    return _ovals(points, cut(_solved(c.groupBy(path).agg(*_moments()), path)), path)


def _moments() -> list[Column]:
    """Of a path's rows of _about_means(): where its mean is, its spread, and the sums of its normal equations, null without spread."""
    u, v = (F.when(F.col("scale") > 1e-9, F.col(c) / F.col("scale")) for c in "uv")
    terms = (u * u, u * v, v * v, u, v)
    sums = [F.sum(terms[i] * terms[j]).alias(f"m{i}{j}") for i in range(5) for j in range(i, 5)] + [F.sum(terms[i]).alias(f"r{i}") for i in range(5)]
    return [*(F.first(c).alias(c) for c in ("mx", "my", "scale")), *sums]


def _solved(moments: DataFrame, path: str) -> DataFrame:
    """(path, cx, cy, a, b, angle) of the paths whose _moments() give an ellipse."""
    kind = moments.schema[path].dataType.simpleString()

    def solve(batches):
        for b in batches:
            col = {n: b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in b.schema.names if n != path}
            m, r = np.empty((b.num_rows, 5, 5)), np.stack([col[f"r{i}"] for i in range(5)], 1)
            for i in range(5):
                for j in range(5):
                    m[:, i, j] = col[f"m{min(i, j)}{max(i, j)}"]
            ok = np.linalg.cond(m) < 1e12 if len(m) else np.zeros(0, bool)
            k = np.zeros((b.num_rows, 5))
            k[ok] = np.linalg.solve(m[ok], r[ok][:, :, None])[:, :, 0]
            p, q, s, d, e = k.T
            det = 4 * p * s - q * q
            ok &= det > 1e-12
            with np.errstate(all="ignore"):
                cu, cv = (q * e - 2 * s * d) / det, (q * d - 2 * p * e) / det
                level = 1 + p * cu * cu + q * cu * cv + s * cv * cv
                angle = np.arctan2(q, p - s) / 2
                one = p * np.cos(angle) ** 2 + q * np.cos(angle) * np.sin(angle) + s * np.sin(angle) ** 2
                two = p + s - one
                ok &= (level / one > 0) & (level / two > 0)
                out = [col["mx"] + cu * col["scale"], col["my"] + cv * col["scale"], np.sqrt(level / one) * col["scale"], np.sqrt(level / two) * col["scale"], np.degrees(angle)]
            yield pa.RecordBatch.from_arrays([b.column(path).filter(pa.array(ok)), *(pa.array(x[ok]) for x in out)], names=[path, "cx", "cy", "a", "b", "angle"])

    return moments.mapInArrow(solve, f"`{path}` {kind}, cx double, cy double, a double, b double, angle double")


def _ovals(points: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """found with the fit of each path's points."""
    t = F.radians("angle")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    off = F.abs(((dx * F.cos(t) + dy * F.sin(t)) / F.col("a")) ** 2 + ((dy * F.cos(t) - dx * F.sin(t)) / F.col("b")) ** 2 - 1)
    return points.join(found, path).groupBy(*found.columns).agg(F.greatest(F.lit(0.0), 1 - F.avg(off)).alias("fit"))


def curve_kinds(points: DataFrame, path: str) -> DataFrame:
    """(path, n, kind, fit): line, circle, arc, ellipse or spline.

    Few points or little curvature make a line. Even curvature and a circle that fits make a circle where the points' angles span more than
    1.8 pi (between -pi and pi, so an arc across pi counts as a circle), else an arc. Then an ellipse that fits; what is left is a spline.
    """
    n, w = F.col("n"), Window.partitionBy(path).orderBy("pos")
    near = lambda f, c, k: f(c, k).over(w)
    p = points.where(F.col(path).isNotNull()).withColumn("_back", F.lag("pos").over(w)).withColumn("_on", F.lead("pos").over(w))
    # an end takes the two next to it
    trio = [(F.when(F.col("_back").isNull(), F.col(c)).when(F.col("_on").isNull(), near(F.lag, c, 2)).otherwise(near(F.lag, c, 1)), F.when(F.col("_back").isNull(), near(F.lead, c, 1)).when(F.col("_on").isNull(), near(F.lag, c, 1)).otherwise(F.col(c)), F.when(F.col("_back").isNull(), near(F.lead, c, 2)).when(F.col("_on").isNull(), F.col(c)).otherwise(near(F.lead, c, 1))) for c in ("x", "y")]
    bent = p.select(path, "pos", "x", "y", _menger(*zip(*trio, strict=True), 2.0).alias("k"))
    # one pass over a path's rows, sorted once: its bends, its circle and the sums of its ellipse; joins of each would all be held by one task
    c = _about_circles(bent, path).withColumn("t", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    by = cut(c.groupBy(path).agg(*_circle(), *_moments(), F.avg("k").alias("mean"), F.stddev_pop("k").alias("sd"), (F.max("t") - F.min("t")).alias("range")))
    solvable = by.where("n >= 5 AND scale > 1e-9").select(path, "mx", "my", "scale", *(m for m in by.columns if m[0] in "mr" and m[1:].isdigit()))
    oval = _ovals(points, cut(_solved(solvable, path)), path).select(path, F.col("fit").alias("oval"))
    all_ = by.withColumn("round", F.when(F.col("radius").isNotNull(), _fit())).join(oval, path, "left")
    line = (n < FEWEST) | (F.col("mean") < CURVED)
    even = (F.col("sd") < 0.3 * F.col("mean")) & (F.coalesce("round", F.lit(0.0)) > GOOD)
    kind = F.when(line, "line").when(even, F.when(F.col("range") > 1.8 * math.pi, "circle").otherwise("arc")).when(F.coalesce("oval", F.lit(0.0)) > GOOD, "ellipse").otherwise("spline")
    return all_.withColumn("kind", kind).select(path, "n", "kind", F.when(F.col("kind").isin("circle", "arc"), F.col("round")).when(F.col("kind") == "ellipse", F.col("oval")).when(F.col("kind") == "spline", 1.0).alias("fit"))


def image_moments(pixels: DataFrame, by: str, weight: str = "v") -> DataFrame:
    """(by, area, cx, cy, h1..h7, elongation): Hu's invariants of each image from summed central moments, and its spread along the axes, the larger over the smaller, a tenth of it, 1 at most."""
    first = pixels.groupBy(by).agg(F.sum(weight).alias("area"), (F.sum(F.col(weight) * F.col("x")) / F.sum(weight)).alias("cx"), (F.sum(F.col(weight) * F.col("y")) / F.sum(weight)).alias("cy")).where("area > 0")
    u, v, m = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col(weight)
    orders = ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))
    s = pixels.join(first, by).groupBy(by, "area", "cx", "cy").agg(*(F.sum(m * u**p * v**q).alias(f"m{p}{q}") for p, q in orders))
    for p, q in orders:
        s = s.withColumn(f"n{p}{q}", F.col(f"m{p}{q}") / F.pow("area", F.lit(1 + (p + q) / 2)))
    n20, n11, n02, n30, n21, n12, n03 = (F.col(f"n{p}{q}") for p, q in orders)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    h = (n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c**2 + d**2, a**2 + b**2, c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2), (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2))
    delta = F.sqrt(4 * F.col("m11") ** 2 + (F.col("m20") - F.col("m02")) ** 2)
    low = F.col("m20") + F.col("m02") - delta
    long = F.when(low > 1e-12 * (F.col("m20") + F.col("m02")), F.least(F.lit(10.0), F.sqrt((F.col("m20") + F.col("m02") + delta) / low)) / 10).otherwise(1.0)
    return s.select(by, "area", "cx", "cy", *(x.alias(f"h{k}") for k, x in enumerate(h, 1)), long.alias("elongation"))


def refined(vertices: DataFrame, pixels: DataFrame, by: str, half: int = 2) -> DataFrame:
    """vertices (by, vertex, x, y) moved to where the grey values around them peak: one Newton step a direction, from smoothed first and second differences of the five by five pixels around, `half` at most.

    A vertex whose window leaves the image, or has no second difference, stays. Pixels: (by, x, y, v), one a place.
    """
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))).alias("o")
    near = vertices.select(by, "vertex", F.round("x").cast("long").alias("ix"), F.round("y").cast("long").alias("iy"), around).select(by, "vertex", "o.*", (F.col("ix") + F.col("o.i")).alias("x"), (F.col("iy") + F.col("o.j")).alias("y"))
    soft = lambda k: F.element_at(F.array(*(F.lit(z) for z in (0, 1, 2, 1, 0))), k + 3)
    softer = lambda k: F.element_at(F.array(*(F.lit(z) for z in (1, 4, 6, 4, 1))), k + 3)
    slope = lambda k: F.when(F.abs(k) == 1, k).otherwise(0)
    bend = lambda k: F.element_at(F.array(*(F.lit(z) for z in (1, 0, -2, 0, 1))), k + 3)
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    s = near.join(pixels, [by, "x", "y"]).groupBy(by, "vertex").agg(F.count("*").alias("n"), F.sum(v * slope(i) * soft(j)).alias("gx"), F.sum(v * slope(j) * soft(i)).alias("gy"), F.sum(v * bend(i) * softer(j)).alias("hx"), F.sum(v * bend(j) * softer(i)).alias("hy"))
    move = lambda g, h: F.when((F.col("n") == 25) & (F.abs(F.col(h)) > 1e-6), F.greatest(F.lit(-float(half)), F.least(F.lit(float(half)), -F.col(g) / F.col(h)))).otherwise(0.0)
    out = vertices.join(s, [by, "vertex"], "left")
    return out.select(by, "vertex", (F.col("x") + F.coalesce(move("gx", "hx"), F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce(move("gy", "hy"), F.lit(0.0))).alias("y"))
