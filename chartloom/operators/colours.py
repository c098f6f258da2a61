"""Colours of images: k-means over each image's distinct colours, then the touching cells of a cluster as segments.

An image is its distinct colours with counts, so pixels are read twice: for these, and to give each its cluster. All images take a
round together; a round is a join of colours with their image's centroids and a sum. Whole numbers throughout: centroids
are floors of means, ties go to the smaller number, so runs and engines agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.grids import components
from chartloom.sources.scratch import Scratch, cut

RGB = ("r", "g", "b")


def palette(pixels: DataFrame, image: str, k: int = 8, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(image, r, g, b, n, cluster, cr, cg, cb): each distinct colour with its cluster and that cluster's centroid.

    Centroids begin as the k colours of smallest MD5 of seed and colour. Fewer colours make as many clusters; an empty cluster keeps its centroid. Colours without a channel are left out.
    """
    scratch = Scratch()
    colours = cut(pixels.where(" AND ".join(f"{c} IS NOT NULL" for c in RGB)).groupBy(image, *RGB).agg(F.count("*").alias("n")))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in RGB)))
    first = colours.select(image, *RGB, F.row_number().over(Window.partitionBy(image).orderBy(draw)).alias("c")).where(F.col("c") <= k)
    centroid = lambda c, r, g, b: F.struct(c.cast("int").alias("c"), r.cast("long").alias("r"), g.cast("long").alias("g"), b.cast("long").alias("b"))
    now = cut(first.groupBy(image).agg(F.array_sort(F.collect_list(centroid(F.col("c") - 1, *map(F.col, RGB)))).alias("cs")), scratch)

    def nearest(cents: DataFrame) -> DataFrame:
        far = F.transform("cs", lambda c: F.struct(sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in RGB[1:]), (F.col("r") - c["r"]) * (F.col("r") - c["r"])).alias("d"), c["c"].alias("c"), c.alias("at")))
        return colours.join(cents, image).withColumn("near", F.array_min(far))

    for _ in range(rounds):
        mean = lambda x: F.floor(F.sum(F.col(x) * F.col("n")) / F.sum("n")).cast("long")
        moved = nearest(now).groupBy(image, F.col("near.c").alias("c")).agg(centroid(F.first("near.c"), *map(mean, RGB)).alias("new"))
        held = now.select(image, F.explode("cs").alias("old")).withColumn("c", F.col("old.c")).join(moved, [image, "c"], "left")
        last, now = now, cut(held.groupBy(image).agg(F.array_sort(F.collect_list(F.coalesce("new", "old"))).alias("cs")), scratch)
        scratch.drop(last)
    return nearest(now).select(image, *RGB, "n", F.col("near.c").alias("cluster"), *(F.col(f"near.at.{c}").alias(f"c{c}") for c in RGB))


def is_ground(r: Column, g: Column, b: Column) -> Column:
    """White ground, black lines, and the grey of texts."""
    white, black = (r > 240) & (g > 240) & (b > 240), (r < 15) & (g < 15) & (b < 15)
    return white | black | ((F.abs(b - g) < 20) & (F.abs(g - r) < 20) & (b < 200))


def segments(pixels: DataFrame, image: str, k: int = 8, rounds: int = 10, seed: int = 42, least: int = 500) -> DataFrame:
    """(image, cluster, cr, cg, cb, area, x0, y0, x1, y1, cx, cy): the components of at least `least` cells of each cluster that is no ground."""
    colours = palette(pixels, image, k, rounds, seed).where(~is_ground(F.col("cr"), F.col("cg"), F.col("cb"))).drop("n")
    cells = pixels.join(colours, [image, *RGB]).select(image, "cluster", "x", "y")
    parts = components(cells, [image, "cluster"]).where(F.col("area") >= least)
    at = parts.withColumn("cx", F.floor(F.col("x_sum") / F.col("area")).cast("long")).withColumn("cy", F.floor(F.col("y_sum") / F.col("area")).cast("long"))
    return at.join(colours.select(image, "cluster", "cr", "cg", "cb").distinct(), [image, "cluster"]).select(image, "cluster", "cr", "cg", "cb", "area", "x0", "y0", "x1", "y1", "cx", "cy")


def bars(parts: DataFrame) -> DataFrame:
    """Segments whose box is neither five times as wide as high nor ten times as high as wide."""
    aspect = (F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)
    return parts.where((aspect <= 5) & (aspect >= 0.1))


def slices(parts: DataFrame, width: int, height: int) -> DataFrame:
    """Segments as slices of a pie in the middle of its image: from the angle of their centre, as wide as their share of the pie's area."""
    x, y, radius = width // 2, height // 2, min(width, height) // 2 - 20
    start = F.atan2(F.col("cy") - y, F.col("cx") - x)
    return parts.select("*", F.lit(radius).alias("radius"), start.alias("angle_start"), (start + F.col("area") / (math.pi * radius * radius) * 2 * math.pi).alias("angle_end"))
