"""Insights over series points (chart_id, series_name, series_idx, point_idx, label, value, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["chart_id", "series_name", "series_idx"]
TINY = 1e-9


def r6(c: Column) -> Column:
    return F.round(c, 6)


def trends(points: DataFrame) -> DataFrame:
    """The direction of each series of three points or more, by its regression slope relative to its mean."""
    by = points.where(F.col("value").isNotNull()).groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.regr_slope("value", "point_idx").alias("slope"), F.avg("value").alias("mean"), F.min_by("value", "point_idx").alias("first"), F.max_by("value", "point_idx").alias("last")
    )
    rel = F.col("slope") / (F.abs("mean") + TINY)
    by = by.where("n >= 3 AND slope IS NOT NULL").withColumn("relative", rel)
    direction = F.when(F.col("relative") > 0.05, "increasing").when(F.col("relative") < -0.05, "decreasing").otherwise("stable")
    confidence = F.when(direction == "stable", 0.7).otherwise(F.least(F.lit(0.9), 0.5 + F.abs("relative")))
    return by.select(*SERIES, "n", r6(F.col("slope")).alias("slope"), direction.alias("direction"), r6(confidence).alias("confidence"), r6((F.col("last") - F.col("first")) / (F.abs("first") + TINY) * 100).alias("pct_change"))


def anomalies(points: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Points further than `threshold` population deviations from their series' mean, in series of four points or more."""
    w = Window.partitionBy(*SERIES)
    z = points.withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w))
    z = z.where(f"n >= 4 AND sd >= {TINY}").withColumn("z", F.abs(F.col("value") - F.col("mean")) / F.col("sd")).where(F.col("z") > threshold)
    return z.select(*SERIES, "point_idx", "label", "value", r6(F.col("z")).alias("z"), r6(F.least(F.lit(0.95), 0.5 + F.col("z") * 0.1)).alias("confidence"))


def comparisons(points: DataFrame) -> DataFrame:
    """The series of highest peak against the one of lowest; of equal peaks the earlier series stands higher."""
    peaks = points.groupBy(*SERIES).agg(F.max("value").alias("peak"))
    key = F.struct(F.col("peak"), -F.col("series_idx"))
    top = peaks.groupBy("chart_id").agg(F.max_by(F.struct("series_name", "peak"), key).alias("hi"), F.min_by(F.struct("series_name", "peak"), key).alias("lo"))
    return top.where(F.abs("hi.peak") >= TINY).select("chart_id", F.col("hi.series_name").alias("dominant"), F.col("hi.peak").alias("dominant_peak"), F.col("lo.series_name").alias("lowest"), r6(F.col("hi.peak") / (F.abs("lo.peak") + TINY)).alias("ratio"))


def half_split_trends(points: DataFrame) -> DataFrame:
    """The later half's mean against the earlier half's, ten percent apart or stable; with plain statistics."""
    w = Window.partitionBy(*SERIES)
    early = F.col("point_idx") < F.floor(F.col("n") / 2)
    by = points.withColumn("n", F.count("*").over(w)).groupBy(*SERIES).agg(
        F.max("n").alias("n"), F.coalesce(F.avg(F.when(early, F.col("value"))), F.lit(0.0)).alias("a"), F.avg(F.when(~early, F.col("value"))).alias("b"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
    )
    trend = F.when(F.col("n") < 2, "insufficient_data").when(F.col("n") < 3, "unknown").when(F.col("b") > F.col("a") * 1.1, "increasing").when(F.col("b") < F.col("a") * 0.9, "decreasing").otherwise("stable")
    return by.select(*SERIES, "n", trend.alias("trend"), "low", "high", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


def distributions(points: DataFrame) -> DataFrame:
    """Each series as shares of its chart: whether they sum to a whole, the largest and smallest, and evenness."""
    w = Window.partitionBy("chart_id")
    share = points.groupBy(*SERIES).agg(F.sum("value").alias("v")).withColumn("share", r6(F.col("v") / F.sum("v").over(w) * 100))
    key = F.struct(F.col("share"), -F.col("series_idx"))
    return share.groupBy("chart_id").agg(
        F.count("*").alias("segments"), F.sum("share").between(95, 105).alias("whole"), F.max_by("series_name", key).alias("dominant"), F.max("share").alias("largest"),
        F.min_by("series_name", key).alias("smallest"), (F.max("share") - F.min("share") < 10).alias("even"),
    )


def top_insights(points: DataFrame, most: int = 5) -> DataFrame:
    """Summary, trends, comparison, then anomalies of each chart, the first `most` of them."""
    summary = points.groupBy("chart_id").agg(F.count("*").alias("k")).select("chart_id", F.lit(0).alias("kind_ord"), F.lit(-1).alias("series_idx"), F.lit(-1).alias("point_idx"), F.lit("summary").alias("kind"), F.lit(0.6).alias("confidence"))
    tr = trends(points).select("chart_id", F.lit(1).alias("kind_ord"), "series_idx", F.lit(-1).alias("point_idx"), F.lit("trend").alias("kind"), "confidence")
    multi = points.groupBy("chart_id").agg(F.countDistinct("series_idx").alias("s")).where("s > 1")
    co = comparisons(points).join(multi, "chart_id", "left_semi").select("chart_id", F.lit(2).alias("kind_ord"), F.lit(-1).alias("series_idx"), F.lit(-1).alias("point_idx"), F.lit("comparison").alias("kind"), F.lit(0.85).alias("confidence"))
    an = anomalies(points).select("chart_id", F.lit(3).alias("kind_ord"), "series_idx", "point_idx", F.lit("anomaly").alias("kind"), "confidence")
    w = Window.partitionBy("chart_id").orderBy("kind_ord", "series_idx", "point_idx")
    return summary.unionByName(tr).unionByName(co).unionByName(an).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("chart_id", "rank", "kind", "series_idx", "point_idx", "confidence")


def validation_warnings(points: DataFrame) -> DataFrame:
    """One warning a series and rule: values that are not finite (the first), and points of low confidence."""
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    by = points.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.min(F.when(odd, F.col("point_idx"))).alias("odd"))
    rules = F.array_compact(F.array(F.when(F.col("odd").isNotNull(), F.concat(F.lit("non_finite at "), F.col("odd").cast("string"))), F.when(F.col("low") > 0, F.concat(F.lit("low_confidence "), F.col("low").cast("string"), F.lit("/"), F.col("n").cast("string")))))
    return by.select(*SERIES, F.posexplode(rules).alias("rule_ord", "warning"))


def session_totals(points: DataFrame) -> DataFrame:
    """Charts, points and series of each session (here a year of charts), with the series list in order."""
    return points.groupBy((F.col("chart_id") % 10000).alias("session")).agg(
        F.countDistinct("chart_id").alias("charts"), F.count("*").alias("points"), F.array_join(F.array_sort(F.collect_set("series_name")), ",").alias("series")
    )


def flattened(points: DataFrame) -> DataFrame:
    """One row a point in text columns, as a CSV sink takes them; null is the empty text."""
    cols = ["chart_id", "series_idx", "series_name", "point_idx", "label"]
    return points.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols), F.format_string("%.2f", "value").alias("value"))
