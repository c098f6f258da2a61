"""Evaluation: text and number metrics per pair, matches, confusion, rolled-up means, ranks and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T


def text_metrics(pairs: DataFrame, pred: str, target: str, keys: list[str]) -> DataFrame:
    """Exact and contained matches, ANLS, CER, BLEU-1 and number recall of each pair."""
    p, t, d = F.col(pred), F.col(target), F.col("_distance")
    pairs = pairs.withColumn(pred, T.nfkc(p)).withColumn(target, T.nfkc(t))
    return pairs.withColumn("_distance", T.distance(p, t)).select(*keys, T.exact_match(p, t).alias("exact"), T.contains_match(p, t).alias("contains"), F.round(T.anls(p, t, d=d), 6).alias("anls"), F.round(T.cer(p, t, d), 6).alias("cer"), F.round(N.number_recall(p, t), 6).alias("numeric"), T.length_category(t).alias("length"))


def nearest_ranks(rows: DataFrame, key: str, x: str, shares: dict[str, float], bins: int = 1024) -> DataFrame:
    """(key, *shares): of each key the values at places floor(n * share) of its sorted values, from 0.

    Equal values are counted first; a histogram of `bins` between a key's extremes finds the bin of each place, and only distinct values of that bin are ranked.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("c"))
    ends = counts.groupBy(key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum("c").alias("n"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0))
    binned = counts.join(ends, key).select(key, x, "c", "n", bin_.cast("int").alias("bin"))
    w = Window.partitionBy(key).orderBy("bin")
    hist = binned.groupBy(key, "bin").agg(F.sum("c").alias("h"), F.first("n").alias("n")).withColumn("before", F.sum("h").over(w) - F.col("h"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("share"), F.floor(F.col("n") * v).alias("place")) for k, v in shares.items())))
    at = hist.select(key, "bin", "h", "before", wanted.alias("s")).where("s.place >= before AND s.place < before + h").select(key, "bin", "s.share", (F.col("s.place") - F.col("before")).alias("place"))
    inside = Window.partitionBy(key, "share").orderBy(x)
    found = binned.join(at, [key, "bin"]).withColumn("upto", F.sum("c").over(inside)).where("place < upto AND place >= upto - c")
    return found.groupBy(key).agg(*(F.max(F.when(F.col("share") == k, F.col(x))).alias(k) for k in shares))


def latency_report(rows: DataFrame, key: str, x: str) -> DataFrame:
    plain = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))
    return plain.join(nearest_ranks(rows, key, x, {"p50": 0.5, "p95": 0.95}), key).select(key, "n", "mean", "p50", "p95", "low", "high")


def confusion(rows: DataFrame, gt: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, gt: str, pred: str) -> DataFrame:
    """Precision, recall and F1 of each class that truth or prediction names."""
    both = rows.select(F.explode(F.array(F.struct(F.col(gt).alias("cls"), F.lit(1).alias("is_gt"), F.lit(0).alias("is_pred"), (F.col(gt) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("is_gt"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    by = both.groupBy("cls").agg(F.sum("is_gt").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("hit").alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return by.select("cls", "support", "predicted", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def grouping_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key alone, in one pass, partly summed before the shuffle; null is unknown."""
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in keys))
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def worst(rows: DataFrame, key: str, score: str, most: int = 20) -> DataFrame:
    return rows.orderBy(score, key).limit(most)


def error_rates(rows: DataFrame, key: str, score: str, least: float) -> DataFrame:
    bad = F.col(score) < least
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"), F.round(F.avg(bad.cast("int")), 6).alias("rate"), F.round(F.avg(score), 6).alias("mean"), F.round(F.median(score), 6).alias("median"), F.round(F.stddev_pop(score), 6).alias("sd"))


def deltas(means: DataFrame, group: str, value: str, baseline: str) -> DataFrame:
    """Each group's value against the baseline's: difference, relative change, and a band."""
    base = means.where(F.col(group) == baseline).select(F.col(value).alias("base"))
    both = means.join(F.broadcast(base))  # one row
    rel = (F.col(value) - F.col("base")) / F.abs("base")
    return both.select(group, value, F.round(F.col(value) - F.col("base"), 6).alias("delta"), F.round(rel, 6).alias("relative"), F.when(F.abs(rel) < 0.01, "same").when(rel > 0, "higher").otherwise("lower").alias("band"))


def class_weights(rows: DataFrame, cls: str) -> DataFrame:
    """Inverse-frequency weights: all rows over classes times a class's rows."""
    by = rows.groupBy(cls).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    return by.select(cls, "n", F.round(F.sum("n").over(total) / (F.count("*").over(total) * F.col("n")), 6).alias("weight"))
