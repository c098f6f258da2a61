"""Evaluation of extracted charts against annotations: per-chart comparison, roll-ups, class reports, ranking, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chart types that count as one, tolerances of counts and of axis bounds.
SAME_TYPE = {"stacked_bar": "bar", "grouped_bar": "bar", "donut": "pie"}
COUNT_TOLERANCE, AXIS_TOLERANCE = 0.25, 0.15
BOUNDS = ("x_min", "x_max", "y_min", "y_max")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def folded_type(chart_type: Column) -> Column:
    out = F.when(F.lit(False), chart_type)
    for k, v in SAME_TYPE.items():
        out = out.when(chart_type == k, v)
    return out.otherwise(chart_type)


def counted_number(text: Column) -> Column:
    """The first whole number in a count such as "~400"; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("int"), F.lit(0))


def element_comparison(gt_type: Column, gt_count: Column, types: Column) -> Column:
    """A struct of how an annotation's count of its element type fits the array of predicted types: points count for lines."""
    matches = F.filter(types, lambda t: (t == gt_type) | ((gt_type == "line") & (t == "point")))
    seen = F.size(matches)
    error = F.when(gt_count == 0, F.when(seen == 0, 0.0).otherwise(1.0)).otherwise(F.abs(seen - gt_count) / gt_count)
    return F.struct(gt_count.alias("gt_count"), seen.alias("pred_count"), F.size(types).alias("pred_total"), error.alias("error"), (error <= COUNT_TOLERANCE).alias("within"), (seen > 0).alias("type_correct"))


def axis_comparison(gt: str, pred: str) -> Column:
    """A struct of how many bounds an annotation gives, how many are within tolerance, and the errors of those that are predicted."""

    def one(b):
        g, p = F.col(f"{gt}.{b}"), F.col(f"{pred}.{b}")
        error = F.when(F.abs(g) < 1e-10, F.when(F.abs(p) > 1e-10, F.abs(p)).otherwise(0.0)).otherwise(F.abs(p - g) / F.abs(g))
        return F.when(g.isNotNull(), F.struct(F.lit(b).alias("bound"), F.when(p.isNotNull(), error).alias("error")))

    given = F.array_compact(F.array(*map(one, BOUNDS)))
    known = F.filter(given, lambda x: x["error"].isNotNull())
    return F.struct(F.size(given).alias("total"), F.size(F.filter(known, lambda x: x["error"] <= AXIS_TOLERANCE)).alias("within"), F.size(known).alias("known"), F.aggregate(known, F.lit(0.0), lambda s, x: s + x["error"]).alias("errors"))


def chart_results(annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row an annotation (chart_id, chart_type, difficulty, gt_type, gt_count, axis) with its comparison; a chart without a prediction stays as an error row.

    predictions: (chart_id, pred_type, types array, axis, overall, seconds, failed).
    """
    both = annotations.join(predictions.withColumnRenamed("axis", "pred_axis").withColumn("there", F.lit(True)), "chart_id", "left")
    error = F.when(F.col("there").isNull(), "missing_image_or_annotation").when(F.col("failed"), "failed")
    both = both.withColumn("error", error).withColumn("e", element_comparison(F.col("gt_type"), counted_number(F.col("gt_count")), F.coalesce("types", F.array().cast("array<string>")))).withColumn("a", axis_comparison("axis", "pred_axis"))
    return both.select("chart_id", "chart_type", F.coalesce("pred_type", F.lit("unknown")).alias("pred_type"), "difficulty", "error", (folded_type(F.col("chart_type")) == folded_type(F.coalesce("pred_type", F.lit("unknown")))).alias("classified"), "e", "a", F.coalesce("overall", F.lit(0.0)).alias("overall"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def result_rollup(results: DataFrame) -> DataFrame:
    """Rows (section, key, metric, value): all charts, by chart type, by difficulty; error rows only count as errors. Ratios of nothing are 0."""
    ok = F.col("error").isNull()
    counted = ok & (F.col("e.gt_count") > 0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    flag = lambda c: c.cast("double")
    metrics = {
        "charts": F.count("*").cast("double"), "errors": F.count_if(~ok).cast("double"), "classification_accuracy": ratio(flag(ok & F.col("classified")), flag(ok)), "element_tolerance_accuracy": ratio(flag(counted & F.col("e.within")), flag(counted)),
        "element_exact": F.count_if(counted & (F.col("e.gt_count") == F.col("e.pred_count"))).cast("double"), "element_type_accuracy": ratio(flag(counted & F.col("e.type_correct")), flag(counted)), "element_mean_error": ratio(F.when(counted, F.col("e.error")).otherwise(0.0), flag(counted)),
        "axis_ranges": F.coalesce(F.sum(F.when(ok, F.col("a.total"))), F.lit(0)).cast("double"), "axis_accuracy": ratio(F.when(ok, F.col("a.within")).otherwise(0), F.when(ok, F.col("a.total")).otherwise(0)), "axis_mean_error": ratio(F.when(ok, F.col("a.errors")).otherwise(0.0), F.when(ok, F.col("a.known")).otherwise(0)),
        "mean_confidence": F.coalesce(F.avg(F.when(ok, F.col("overall"))), F.lit(0.0)), "mean_seconds": F.coalesce(F.avg(F.when(ok, F.col("seconds"))), F.lit(0.0)),
    }
    sections = F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in (("summary", F.lit("all")), ("chart_type", F.col("chart_type")), ("difficulty", F.col("difficulty")))))
    by = results.withColumn("x", F.explode(sections)).groupBy("x.section", "x.key").agg(*(r6(v).alias(k) for k, v in metrics.items()))
    return by.select("section", "key", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics))).alias("x")).select("section", "key", "x.*")


def error_confusion(results: DataFrame) -> DataFrame:
    """Counts of "truth->prediction" over misclassified charts."""
    return results.where(F.col("error").isNull() & ~F.col("classified")).groupBy(F.concat_ws("->", "chart_type", "pred_type").alias("pair")).agg(F.count("*").alias("n"))


def audit_rows(results: DataFrame, least: float = 0.5) -> DataFrame:
    """Each chart's failure flags, an error being the only one of an error row."""
    flags = F.array_compact(F.array(F.when(~F.col("classified"), "classification"), F.when(F.col("e.pred_total") == 0, "no_elements"), F.when(~F.col("e.within"), "element_count"), F.when(F.col("a.within") < F.col("a.total"), "axis"), F.when(F.col("overall") < least, "low_confidence")))
    return results.select("chart_id", "chart_type", F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("error: "), F.col("error")))).otherwise(flags).alias("failures"))


def type_summary(results: DataFrame) -> DataFrame:
    """By chart type: rows, errors, and over the others successes of classification and of axes, mean confidence, and the most frequent first words of failures."""
    flagged = audit_rows(results).select("chart_id", F.col("failures"))
    rows = results.join(flagged, "chart_id")
    ok = F.col("error").isNull()
    by = rows.groupBy("chart_type").agg(F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.count_if(ok & F.col("classified")).alias("classified"), F.count_if(ok & (F.col("a.total") > 0) & (F.col("a.within") == F.col("a.total"))).alias("axes_right"), r6(F.avg(F.when(ok, F.col("overall")))).alias("mean_confidence"))
    reasons = rows.select("chart_type", F.explode("failures").alias("f")).groupBy("chart_type", F.split("f", ":")[0].alias("reason")).agg(F.count("*").alias("k"))
    listed = reasons.groupBy("chart_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "reason"))), lambda x: F.concat(x["reason"], F.lit("="), (-x["k"]).cast("string"))), ",").alias("reasons"))
    return by.join(listed, "chart_type", "left")


def classifier_report(rows: DataFrame, gt: str, pred: str, classes: tuple[str, ...]) -> DataFrame:
    """Rows (cls, support, accuracy, precision, recall, f1), 0 where a class never occurs; and "macro" over all classes, "macro_seen" over those in the truth, "accuracy" over all rows."""
    hit = F.col(gt) == F.col(pred)
    pairs = rows.select(F.explode(F.array(F.struct(F.col(gt).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.cast("int").alias("h")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    by = rows.sparkSession.createDataFrame([(c,) for c in classes], "cls string").join(pairs.groupBy("cls").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h")), "cls", "left").na.fill(0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumn("precision", share(F.col("h"), F.col("p"))).withColumn("recall", share(F.col("h"), F.col("t"))).withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    each = by.select("cls", F.col("t").alias("support"), "precision", "recall", "f1")
    seen = F.col("t") > 0
    macro = lambda name, of: by.where(of).agg(F.lit(name).alias("cls"), F.sum("t").alias("support"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    whole = by.agg(F.lit("accuracy").alias("cls"), F.sum("t").alias("support"), share(F.sum("h"), F.sum("t")).alias("precision"), share(F.sum("h"), F.sum("t")).alias("recall"), share(F.sum("h"), F.sum("t")).alias("f1"))
    return each.unionByName(macro("macro", F.lit(True))).unionByName(macro("macro_seen", seen)).unionByName(whole).select("cls", "support", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


def pair_metrics_by(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rates and means of (exact, contains, numeric, bleu, seconds) over all rows and by each dimension: numeric -1 is not applicable and left out, null if none is."""
    sets = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    by = rows.withColumn("x", F.explode(sets)).groupBy("x.dimension", "x.value")
    return by.agg(F.count("*").alias("n"), r6(F.avg(F.col("exact").cast("int"))).alias("exact"), r6(F.avg(F.col("contains").cast("int"))).alias("contains"), r6(F.avg(F.when(F.col("numeric") >= 0, F.col("numeric")))).alias("numeric"), r6(F.avg("bleu")).alias("bleu"), r6(F.avg("seconds")).alias("mean_seconds"), r6(F.try_divide(F.lit(1.0), F.avg("seconds"))).alias("per_second"))


def ranked_models(scores: DataFrame) -> DataFrame:
    """Models (model, ord, exact, contains, numeric, bleu) with their weighted score and place; of equal scores the first stands higher."""
    score = F.col("exact") * 100 * 0.4 + F.col("contains") * 100 * 0.3 + F.coalesce("numeric", F.lit(0.0)) * 100 * 0.2 + F.col("bleu") * 100 * 0.1
    scored = scores.withColumn("score", r6(score))
    return scored.select("model", "score", F.row_number().over(Window.orderBy(F.desc("score"), "ord")).alias("place"))


def suite_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows ("model.metric", mean) of long scores, and each model's "overall", the mean of its metrics' means; four decimals."""
    by = scores.groupBy("model").agg(*(F.avg(m).alias(m) for m in metrics))
    named = [F.struct(F.concat_ws(".", "model", F.lit(m)).alias("name"), F.round(m, 4).alias("mean")) for m in metrics]
    overall = F.struct(F.concat_ws(".", "model", F.lit("overall")).alias("name"), F.round(sum(F.col(m) for m in metrics) / len(metrics), 4).alias("mean"))
    return by.select(F.explode(F.array(*named, overall)).alias("x")).select("x.*")


def pairwise_winners(means: DataFrame, name: str, value: str, least: float = 0.0) -> DataFrame:
    """Each pair of a few variants with the better one (or "tie" within `least`) and the margin."""
    other = means.select(F.col(name).alias("other"), F.col(value).alias("other_value"))
    both = means.join(other, F.col(name) < F.col("other"))
    gap = F.col(value) - F.col("other_value")
    return both.select(F.col(name).alias("one"), "other", F.when(F.abs(gap) <= least, "tie").when(gap > 0, F.col(name)).otherwise(F.col("other")).alias("winner"), r6(F.abs(gap)).alias("margin"))


def run_summaries(stages: DataFrame) -> DataFrame:
    """Of each run's stages (run_id, ord, stage, ok, started, ended): whether all succeeded, the first that failed, whole milliseconds in all and of the longest."""
    took = (F.col("ended") - F.col("started")) / 1000
    by = stages.withColumn("ms", took.cast("long")).groupBy("run_id").agg(F.bool_and("ok").alias("ok"), F.min_by("stage", F.when(~F.col("ok"), F.col("ord"))).alias("first_failed"), F.sum("ms").alias("ms"), F.max_by("stage", F.struct(F.col("ms"), -F.col("ord"))).alias("longest"), F.count("*").alias("stages"))
    return by.withColumn("took", human_duration(F.col("ms") / 1000))


def human_duration(seconds: Column) -> Column:
    """Seconds as "1h 02m 03s", "2m 03s" or "3.4s"."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), (whole % 60).cast("long")
    tenths = F.floor(seconds * 10).cast("long")
    return F.when(whole >= 3600, F.format_string("%dh %02dm %02ds", h, m, s)).when(whole >= 60, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%d.%ds", F.floor(tenths / 10).cast("long"), tenths % 10))


def human_size(n: Column) -> Column:
    """Bytes as whole units with one decimal, cut: "1.5 KB"."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        tenths = F.floor(n * 10 / 1024**k).cast("long")
        text = F.format_string(f"%d.%d {unit}", F.floor(tenths / 10).cast("long"), tenths % 10)
        out = out.when(n < 1024 ** (k + 1), text) if unit != "TB" else out.otherwise(text)
    return out


def quality_label(confidence: Column) -> Column:
    return F.when(confidence > 0.9, "high").when(confidence > 0.7, "medium").otherwise("low")


def overall_confidence(*parts: Column, weights: tuple[float, ...] = (0.3, 0.25, 0.25, 0.2)) -> Column:
    return sum(p * w for p, w in zip(parts, weights, strict=True))


def size_profile(images: DataFrame) -> DataFrame:
    """Extremes and means of (width, height), and overlapping classes: small if either side is below 200, large if either is above 1000, medium if both lie between 200 and 1000."""
    w, h = F.col("width"), F.col("height")
    return images.agg(F.count("*").alias("n"), F.min("width").alias("least_width"), F.max("width").alias("most_width"), r6(F.avg("width")).alias("mean_width"), F.min("height").alias("least_height"), F.max("height").alias("most_height"), r6(F.avg("height")).alias("mean_height"), F.count_if((w < 200) | (h < 200)).alias("small"), F.count_if(w.between(200, 1000) & h.between(200, 1000)).alias("medium"), F.count_if((w > 1000) | (h > 1000)).alias("large"))


def routed(rows: DataFrame, cls: str, confidence: str, least: float) -> DataFrame:
    """Rows by class, those that are not sure as "uncertain", with their share in percent; one row a class."""
    to = F.when(F.col(confidence) < least, "uncertain").otherwise(F.col(cls))
    by = rows.groupBy(to.alias("folder")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("folder", "n", r6(F.col("n") * 100 / F.col("total")).alias("percent"))
