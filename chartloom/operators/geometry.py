"""Paths: length, curvature, simplification; circle fits by normal equations; runs above a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def path_facts(points: DataFrame, path: str) -> DataFrame:
    """Number of points, length and bounding box of each path (path, pos, x, y)."""
    w = Window.partitionBy(path).orderBy("pos")
    step = points.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return step.groupBy(path).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 4).alias("length"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def curvature(points: DataFrame, path: str) -> DataFrame:
    """Menger curvature at each inner point: four times the triangle's area over the product of its sides."""
    w = Window.partitionBy(path).orderBy("pos")
    p = points
    for n, f in (("a", F.lag), ("b", F.lead)):
        p = p.withColumn(f"x{n}", f("x").over(w)).withColumn(f"y{n}", f("y").over(w))
    area2 = F.abs((F.col("x") - F.col("xa")) * (F.col("yb") - F.col("ya")) - (F.col("xb") - F.col("xa")) * (F.col("y") - F.col("ya")))
    side = lambda a, b, c, d: F.hypot(F.col(a) - F.col(c), F.col(b) - F.col(d))
    sides = side("x", "y", "xa", "ya") * side("x", "y", "xb", "yb") * side("xa", "ya", "xb", "yb")
    return p.where("xa IS NOT NULL AND xb IS NOT NULL").select(path, "pos", F.round(F.when(sides > 1e-10, 2 * area2 / sides).otherwise(0.0), 8).alias("curvature"))


def simplified(points: DataFrame, path: str, epsilon: float) -> DataFrame:
    """Points that stay when each stretch is cut at its furthest point from the chord while that is beyond epsilon. One group is one path."""

    def kept(group) -> list:
        group = sorted(group, key=lambda r: r["pos"])
        xy = np.array([(r["x"], r["y"]) for r in group], float)
        keep = np.zeros(len(xy), bool)
        keep[[0, -1]] = True
        todo = [(0, len(xy) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            chord, rel = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            size = np.hypot(*chord)
            d = np.abs(chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / size if size > 0 else np.hypot(rel[:, 0], rel[:, 1])
            k = int(d.argmax())
            if d[k] > epsilon:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return [r["pos"] for r, ok in zip(group, keep, strict=True) if ok]

    def run(it):
        for pdf in it:
            yield pd.DataFrame({path: pdf[path], "pos": [kept(g) for g in pdf["points"]]}).explode("pos").astype({"pos": "int64"})

    by = points.groupBy(path).agg(F.collect_list(F.struct("pos", "x", "y")).alias("points"))
    return by.mapInPandas(run, f"{path} long, pos long")


def circles(points: DataFrame, path: str) -> DataFrame:
    """The least-squares circle of each path, its 3 by 3 normal equations solved from sums alone."""
    z = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    mean = Window.partitionBy(path)
    c = points.withColumn("mx", F.avg("x").over(mean)).withColumn("my", F.avg("y").over(mean)).withColumn("x", F.col("x") - F.col("mx")).withColumn("y", F.col("y") - F.col("my"))
    s = c.groupBy(path).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(z * F.col("x")).alias("zx"), F.sum(z * F.col("y")).alias("zy"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    u = (F.col("zx") * F.col("yy") - F.col("zy") * F.col("xy")) / (2 * det)
    v = (F.col("zy") * F.col("xx") - F.col("zx") * F.col("xy")) / (2 * det)
    return s.where(det > 1e-6).select(path, "n", F.round(u + F.col("mx"), 4).alias("cx"), F.round(v + F.col("my"), 4).alias("cy"), F.round(F.sqrt(u * u + v * v + (F.col("xx") + F.col("yy")) / F.col("n")), 4).alias("radius"))


def runs_above(profile: DataFrame, key: str, threshold: float, least: int) -> DataFrame:
    """Stretches of (key, pos, v) with v above the threshold, at least `least` long: islands by the difference of two numberings."""
    w = Window.partitionBy(key).orderBy("pos")
    up = profile.withColumn("all", F.row_number().over(w)).where(F.col("v") > threshold)
    island = F.col("all") - F.row_number().over(w)
    return up.withColumn("island", island).groupBy(key, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.max("v").alias("peak")).where(F.col("n") >= least).drop("island")
