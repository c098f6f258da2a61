"""Axis calibration: fits of pixel against value, robust fits, scale patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ols(ticks: DataFrame, axis: str = "axis_id") -> DataFrame:
    """Slope, intercept, R² and residual deviation of each axis with two ticks or more at different pixels."""
    by = ticks.groupBy(axis).agg(F.count("*").alias("n"), F.regr_slope("value", "pixel").alias("slope"), F.regr_intercept("value", "pixel").alias("intercept"), F.regr_r2("value", "pixel").alias("r2"), F.regr_syy("value", "pixel").alias("syy"))
    by = by.where("n >= 2 AND slope IS NOT NULL")
    return by.select(axis, "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("syy") / F.col("n"))), 4).alias("residual_sd"))


def theil_sen(ticks: DataFrame, axis: str = "axis_id") -> DataFrame:
    """Median slope over pairs of ticks of an axis (a few dozen at most), and the median intercept at that slope."""
    xs = ticks.groupBy(axis).agg(F.array_sort(F.collect_list(F.struct("pixel", "value"))).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.filter(F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda b: b["pixel"] > a["pixel"]), lambda b: (b["value"] - a["value"]) / (b["pixel"] - a["pixel"]))))
    slope = xs.select(axis, "t", F.explode(pairs).alias("s")).groupBy(axis).agg(F.median("s").alias("slope"))
    return ticks.join(slope, axis).groupBy(axis).agg(F.round(F.first("slope"), 6).alias("slope"), F.round(F.median(F.col("value") - F.col("slope") * F.col("pixel")), 6).alias("intercept"))


def ransac_pairs(ticks: DataFrame, axis: str = "axis_id", tolerance: float = 10.0) -> DataFrame:
    """The line through two ticks that most ticks of the axis lie within `tolerance` of; every pair is tried, the first of equals wins."""
    xs = ticks.groupBy(axis).agg(F.array_sort(F.collect_list(F.struct("pixel", "value"))).alias("t"))
    line = lambda a, b: F.struct(a["pixel"].alias("p"), b["pixel"].alias("q"), ((b["value"] - a["value"]) / (b["pixel"] - a["pixel"])).alias("m"), a["value"].alias("v"))
    lines = F.flatten(F.transform("t", lambda a, i: F.transform(F.filter(F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda b: b["pixel"] > a["pixel"]), lambda b: line(a, b))))
    scored = xs.select(axis, "t", F.explode(lines).alias("l")).withColumn("inliers", F.size(F.filter("t", lambda x: F.abs(x["value"] - (F.col("l.v") + F.col("l.m") * (x["pixel"] - F.col("l.p")))) < tolerance)))
    best = scored.groupBy(axis).agg(F.max_by(F.struct("l", "inliers"), F.struct(F.col("inliers"), -F.col("l.p"), -F.col("l.q"))).alias("x"), F.first(F.size("t")).alias("n"))
    return best.select(axis, "n", F.col("x.inliers").alias("inliers"), F.round("x.l.m", 6).alias("slope"), F.round(F.col("x.l.v") - F.col("x.l.m") * F.col("x.l.p"), 4).alias("intercept"))


def linear_or_log(ticks: DataFrame, axis: str = "axis_id", gain: float = 0.1) -> DataFrame:
    """Which fits better: log only if all values are positive and its R² is more than `gain` higher."""
    safe = F.when(F.col("value") > 0, F.log10("value"))
    by = ticks.groupBy(axis).agg(F.regr_r2("value", "pixel").alias("lin"), F.regr_r2(safe, "pixel").alias("log"), F.bool_and(F.col("value") > 0).alias("positive"))
    return by.select(axis, F.round("lin", 6).alias("r2_linear"), F.round(F.when(F.col("positive"), F.col("log")), 6).alias("r2_log"), F.when(F.col("positive") & (F.col("log") - F.col("lin") > gain), "log").otherwise("linear").alias("scale"))


def scale_pattern(values: DataFrame, axis: str, value: str) -> DataFrame:
    """Percentage, ratio, powers of ten or two, or linear, by the sorted distinct values of an axis."""
    xs = values.groupBy(axis).agg(F.array_sort(F.collect_set(value)).alias("v"))
    steps = F.transform(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), lambda x, i: x / F.get("v", i))
    positive = F.forall("v", lambda x: x > 0)
    near = lambda k: F.forall(steps, lambda s: F.abs(s - k) < 0.01 * k)
    last = F.element_at("v", -1)
    kind = F.when(F.size("v") < 2, "unknown").when(positive & near(10.0), "log10").when(positive & near(2.0), "log2").when((F.get("v", F.lit(0)) >= 0) & (last <= 1), "ratio").when((F.get("v", F.lit(0)) >= 0) & (last <= 100), "percentage").otherwise("linear")
    return xs.select(axis, F.size("v").alias("n"), kind.alias("pattern"))


def numbered_series(elements: DataFrame, chart: str, colour: str, x: str, pos: str) -> DataFrame:
    """Series by colour in the order in which colours appear, points by x, both numbered from 0."""
    of = Window.partitionBy(chart, colour).orderBy(x, pos)  # one sort gives the place in a series and where its colour is first seen
    first = elements.withColumn("point_idx", F.row_number().over(of) - 1).withColumn("seen", F.min(pos).over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = first.withColumn("series_idx", F.dense_rank().over(Window.partitionBy(chart).orderBy("seen")) - 1)
    return ranked.select(*elements.columns, "series_idx", "point_idx")
