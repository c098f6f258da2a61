"""Sessions of the pipeline: validation, totals, reports, flat files, run registries, trainer logs, resuming, retries, synthetic charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.events import running

#: Columns of the flat file, in order.
FLAT = ("session_id", "chart_id", "chart_type", "chart_title", "series_name", "label", "value", "unit", "confidence", "x_axis_label", "y_axis_label")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def chart_warnings(charts: DataFrame, series: DataFrame, points: DataFrame, describe: bool = True, least: float = 0.5) -> DataFrame:
    """(chart_id, place, warning) in order: an empty id, no description, no series; then by series: none of its points there, the first value that isn't finite, and how many points are unsure."""
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    by = points.groupBy("chart_id", "series_idx").agg(F.count("*").alias("n"), F.min(F.when(odd, F.col("point_idx"))).alias("odd"), F.count_if(F.col("confidence") < least).alias("low"))
    s = series.join(by, ["chart_id", "series_idx"], "left").select("chart_id", "series_idx", F.when(F.col("n").isNull(), F.array(F.concat(F.lit("empty series "), F.col("series_name")))).otherwise(F.array_compact(F.array(
        F.when(F.col("odd").isNotNull(), F.concat(F.lit("non-finite value in "), F.col("series_name"), F.lit(" at "), F.col("odd").cast("string"))), F.when(F.col("low") > 0, F.concat(F.lit("low confidence in "), F.col("series_name"), F.lit(": "), F.col("low").cast("string"), F.lit("/"), F.col("n").cast("string")))))).alias("w"))
    by_chart = s.groupBy("chart_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("series_idx", "w"))), lambda x: x["w"])).alias("sw"))
    j = charts.join(by_chart, "chart_id", "left")
    own = F.array_compact(F.array(F.when(F.trim(F.coalesce(F.col("chart_id").cast("string"), F.lit(""))) == "", "empty chart id"), F.when(F.lit(describe) & (F.coalesce("description", F.lit("")) == ""), "no description"), F.when(F.col("sw").isNull(), "no data series")))
    return j.select("chart_id", F.posexplode(F.concat(own, F.coalesce("sw", F.array().cast("array<string>")))).alias("place", "warning"))


def session_summary(charts: DataFrame, points: DataFrame, insights: DataFrame) -> DataFrame:
    """By session: charts, points and insights, the types with their counts as one text, types by name."""
    types = charts.groupBy("session_id", "chart_type").agg(F.count("*").alias("n"))
    listed = types.groupBy("session_id").agg(F.sum("n").alias("charts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chart_type", "n"))), lambda t: F.concat(t["n"].cast("string"), F.lit(" "), t["chart_type"])), ", ").alias("types"))
    of = charts.select("session_id", "chart_id")
    p = points.groupBy("chart_id").agg(F.count("*").alias("p")).join(of, "chart_id").groupBy("session_id").agg(F.sum("p").alias("points"))
    i = insights.groupBy("chart_id").agg(F.count("*").alias("i")).join(of, "chart_id").groupBy("session_id").agg(F.sum("i").alias("insights"))
    return listed.join(p, "session_id", "left").join(i, "session_id", "left").na.fill(0, ["points", "insights"])


def summary_insights(points: DataFrame, most: int = 3) -> DataFrame:
    """One sentence a chart: its points and series, and up to `most` of the series' names."""
    s = points.groupBy("chart_id", "series_idx", "series_name").agg(F.count("*").alias("n"))
    by = s.groupBy("chart_id").agg(F.sum("n").alias("n"), F.count("*").alias("s"), F.array_sort(F.collect_list(F.struct("series_idx", "series_name"))).alias("names"))
    shown = F.array_join(F.transform(F.slice("names", 1, most), lambda x: x["series_name"]), ", ")
    return by.select("chart_id", F.concat(F.lit("Chart contains "), F.col("n").cast("string"), F.lit(" data points across "), F.col("s").cast("string"), F.lit(" series ("), shown, F.lit(")")).alias("text"))


def flat_rows(charts: DataFrame, points: DataFrame) -> DataFrame:
    """One row a point, the FLAT columns as texts; null is empty."""
    j = points.join(charts, "chart_id")
    return j.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FLAT))


def text_report(charts: DataFrame, points: DataFrame, most: int = 5) -> DataFrame:
    """(chart_id, report): a block of plain text a chart: its head, and for each series its size and first points."""
    p = points.groupBy("chart_id", "series_idx", "series_name").agg(F.array_sort(F.collect_list(F.struct("point_idx", F.col("label").cast("string").alias("label"), F.format_string("%.2f", "value").alias("v")))).alias("ps"))
    shown = F.array_join(F.transform(F.slice("ps", 1, most), lambda x: F.concat(x["label"], F.lit("="), x["v"])), ", ")
    line = F.concat(F.lit("  "), F.col("series_name"), F.lit(" ("), F.size("ps").cast("string"), F.lit(" points): "), shown, F.when(F.size("ps") > most, " ...").otherwise(""))
    s = p.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("series_idx", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("Chart "), F.col("chart_id").cast("string"), F.lit(" ["), F.col("chart_type"), F.lit("] "), F.coalesce("chart_title", F.lit("Untitled")))
    return charts.join(s, "chart_id").select("chart_id", F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("report"))


def document_report(charts: DataFrame, points: DataFrame, warnings: DataFrame, most: int = 20) -> DataFrame:
    """(session_id, report): a Markdown document a session: its summary, a table of types, each chart with a table of every series' first `most` points, and its warnings. A session's charts are one text."""
    p = points.groupBy("chart_id", "series_idx", "series_name").agg(F.array_sort(F.collect_list(F.struct("point_idx", F.concat(F.lit("| "), F.col("label").cast("string"), F.lit(" | "), F.format_string("%.2f", "value"), F.lit(" |")).alias("line")))).alias("ps"))
    table = F.concat(F.lit("### "), F.col("series_name"), F.lit("\n| Label | Value |\n|---|---|\n"), F.array_join(F.transform(F.slice("ps", 1, most), lambda x: x["line"]), "\n"))
    s = p.groupBy("chart_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series_idx", table.alias("t")))), lambda x: x["t"]), "\n").alias("tables"))
    w = warnings.groupBy("chart_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "warning"))), lambda x: F.concat(F.lit("- "), x["warning"])), "\n").alias("warned"))
    j = charts.join(s, "chart_id").join(w, "chart_id", "left")
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce("chart_title", F.concat(F.lit("Chart "), F.col("chart_id").cast("string")))), F.col("tables"), F.when(F.col("warned").isNotNull(), F.concat(F.lit("**Warnings**\n"), F.col("warned"))))
    types = j.groupBy("session_id", "chart_type").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chart_type", "n"))), lambda t: F.concat(F.lit("| "), t["chart_type"], F.lit(" | "), t["n"].cast("string"), F.lit(" |"))), "\n").alias("types"))
    blocks = j.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chart_id", block.alias("b")))), lambda x: x["b"]), "\n").alias("blocks"))
    return types.join(blocks, "session_id").select("session_id", F.concat_ws("\n", F.concat(F.lit("# Session "), F.col("session_id").cast("string")), F.concat(F.lit("Charts: "), F.col("n").cast("string")), F.lit("| Type | Charts |\n|---|---|"), F.col("types"), F.col("blocks")).alias("report"))


def provenance(charts: DataFrame) -> DataFrame:
    """Each chart with the struct that says where it comes from: file, page, place, box and the confidence of each stage."""
    return charts.select("chart_id", F.struct("source_file", "page", "place", F.struct("x0", "y0", "x1", "y1").alias("box"), F.struct("detection", "extraction").alias("confidence")).alias("provenance"))


def flat_runs(runs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """(run_id, name, value) of a map of metrics as texts: numbers alone, their names as agg_..."""
    e = runs.select("run_id", F.explode(metrics).alias("k", "v"))
    return e.select("run_id", F.concat(F.lit("agg_"), F.col("k")).alias("name"), F.expr("try_cast(v AS double)").alias("value")).where("value IS NOT NULL")


def last_runs(runs: DataFrame, order: list[str], most: int = 20, status: str | None = None) -> DataFrame:
    """The last `most` runs, optionally of one status, newest first."""
    kept = runs if status is None else runs.where(F.col("status") == status)
    return kept.orderBy(*(F.desc(c) for c in order)).limit(most)


def latest_metrics(details: DataFrame, metrics: list[str]) -> DataFrame:
    """By prefix the run of greatest name, and its models' means of metrics, 0 where a model has no number."""
    last = details.groupBy("prefix").agg(F.max("run_name").alias("run_name"))
    d = details.join(last, ["prefix", "run_name"])
    return d.groupBy("prefix", "run_name", "model").agg(*(r6(F.coalesce(F.avg(F.expr(f"try_cast(`{m}` AS double)")), F.lit(0.0))).alias(m) for m in metrics))


def trainer_states(logs: DataFrame) -> DataFrame:
    """By run the highest step, the last training loss (rows without an evaluation loss), the last and the best evaluation loss."""
    train = F.col("loss").isNotNull() & F.col("eval_loss").isNull()
    return logs.groupBy("run_id").agg(F.max("step").alias("step"), F.max_by("loss", F.when(train, F.col("step"))).alias("loss"), F.max_by("eval_loss", F.when(F.col("eval_loss").isNotNull(), F.col("step"))).alias("eval_loss"), F.min("eval_loss").alias("best"))


def resumable(items: DataFrame, done: DataFrame, key: str, every: int) -> DataFrame:
    """What a resumed batch still does, with the number of the checkpoint after which it is saved: done items are skipped, the rest numbered in order, `every` to a checkpoint.

    Numbers come from ranges of the key counted first, so that no task numbers all.
    """
    from chartloom.operators.dataset import ranked

    left = items.join(done.select(key), key, "left_anti")
    return ranked(left, [], key).select(key, F.floor((F.col("rank") - 1) / every).cast("long").alias("checkpoint"))


def retried(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Of each request's attempts (request_id, k from 1, ok, auth_error): how many are made before one succeeds, an authentication error aborts or `most` are spent, what comes of it, and the seconds waited, 2^(k-1) after the k-th failure that is tried again."""
    w = Window.partitionBy("request_id").orderBy("k")
    made = attempts.where(F.col("k") <= most).withColumn("over", F.coalesce(F.max(F.when(F.col("ok") | F.col("auth_error"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("over = 0")
    by = made.groupBy("request_id").agg(F.count("*").alias("made"), F.bool_or("ok").alias("ok"), F.bool_or(F.col("auth_error") & ~F.col("ok")).alias("auth"))
    n = F.col("made") - 1  # after the last attempt nothing is waited for
    return by.select("request_id", "made", F.when(F.col("ok"), "succeeded").when(F.col("auth"), "aborted").otherwise("exhausted").alias("outcome"), (F.pow(F.lit(2.0), n) - 1).cast("long").alias("waited"))


def health(checks: DataFrame) -> DataFrame:
    """What each check of a provider (provider, ts, result: ok, auth, or another failure) sees: after an authentication failure the cached no, else the result itself.

    The first such failure of each provider is found by a sum before the shuffle, so a busy provider is no group of its own.
    """
    first = checks.where("result = 'auth'").groupBy("provider").agg(F.min("ts").alias("_first"))
    cached = F.coalesce(F.col("ts") > F.col("_first"), F.lit(False))
    return checks.join(first, "provider", "left").select("provider", "ts", cached.alias("cached"), (~cached & (F.col("result") == "ok")).alias("healthy"))


def progress(events: DataFrame, total: int | None = None, width: int = 10_000) -> DataFrame:
    """Running numbers of each worker's items (worker, ord, seconds, status): done, errors, mean seconds, and the estimate of what is left, where a total is known. Spans of `width` in ord are summed apart."""
    sums = {"done": F.lit(1), "errors": (F.col("status") == "error").cast("long"), "_sum": F.coalesce("seconds", F.lit(0.0)), "_known": F.col("seconds").isNotNull().cast("long")}
    out = running(events.select("worker", "ord", "seconds", "status"), "worker", F.col("ord"), width, ["ord"], sums)
    out = out.select("worker", "ord", "done", "errors", F.round(F.try_divide("_sum", "_known"), 9).alias("mean"))
    return out if total is None else out.withColumn("eta", F.round(F.greatest(F.lit(0), F.lit(total) - F.col("done")) * F.col("mean"), 5))


def synthetic_charts(spark, n: int, seed: int = 42, types: tuple[str, ...] = ("bar", "line", "pie"), points: int = 6) -> DataFrame:
    """Points of n made-up charts, their types in turn, by pattern (uniform, increasing, decreasing, wave) and label family (months, quarters, letters); drawn from md5, the same on every run and engine."""
    draw = lambda *c: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *c)), 1, 6), 16, 10).cast("double") / 16777216
    c = spark.range(n).select(F.col("id").alias("chart_id"), F.element_at(F.array(*map(F.lit, types)), (F.col("id") % len(types) + 1).cast("int")).alias("chart_type"))
    text = F.col("chart_id").cast("string")
    c = c.withColumn("pattern", F.element_at(F.array(*map(F.lit, ("uniform", "increasing", "decreasing", "wave"))), (F.floor(draw(text, F.lit("p")) * 4) + 1).cast("int"))).withColumn("family", F.floor(draw(text, F.lit("f")) * 3))
    p = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    noise = draw(text, F.col("k").cast("string"))
    level = F.when(F.col("pattern") == "increasing", F.col("k") * 10.0).when(F.col("pattern") == "decreasing", (points - 1 - F.col("k")) * 10.0).when(F.col("pattern") == "wave", F.when(F.col("k") % 4 == 1, 30.0).when(F.col("k") % 4 == 3, -30.0).otherwise(0.0) + 40).otherwise(0.0)
    value = F.when(F.col("pattern") == "uniform", 10 + noise * 90).otherwise(20 + level + noise * 5)
    label = F.when(F.col("family") == 0, F.concat(F.lit("M"), (F.col("k") % 12 + 1).cast("string"))).when(F.col("family") == 1, F.concat(F.lit("Q"), (F.col("k") % 4 + 1).cast("string"))).otherwise(F.chr(F.lit(65) + F.col("k") % 26))
    return p.select("chart_id", "chart_type", "pattern", F.col("k").alias("point_idx"), label.alias("label"), F.round(value, 4).alias("value"))


def date_parts(year: Column, month: Column, day: Column) -> Column:
    """A date as text from parts that may be missing: month and day default to 1, padded; null without a year."""
    pad = lambda c: F.lpad(F.coalesce(c, F.lit(1)).cast("string"), 2, "0")
    return F.when(year.isNotNull(), F.concat_ws("-", year.cast("string"), pad(month), pad(day)))


def iso_instant(text: Column) -> Column:
    """An ISO 8601 text, with Z or an offset, as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"))


def theil_sen_inliers(ticks: DataFrame, fits: DataFrame, axis: str = "axis_id", sigmas: float = 2.0) -> DataFrame:
    """How many ticks lie within `sigmas` population deviations of a robust line's residuals (all, where they don't vary), and the root mean square of those."""
    d = F.col("value") - (F.col("intercept") + F.col("slope") * F.col("pixel"))
    j = ticks.join(fits, axis).withColumn("d", d)
    sd = j.groupBy(axis).agg(F.stddev_pop("d").alias("sd"))
    kept = F.when(F.col("sd") > 1e-9, F.abs("d") <= sigmas * F.col("sd")).otherwise(F.lit(True))
    return j.join(sd, axis).groupBy(axis).agg(F.count("*").alias("n"), F.count_if(kept).alias("inliers"), F.round(F.sqrt(F.avg(F.when(kept, F.col("d") * F.col("d")))), 4).alias("rms"))


def refitted(ticks: DataFrame, lines: DataFrame, axis: str, tolerance: float) -> DataFrame:
    """A consensus line fitted anew on the ticks within `tolerance` of it; its confidence is the share of those times their R squared."""
    j = ticks.join(lines.select(axis, F.col("slope").alias("m"), F.col("intercept").alias("b")), axis)
    inside = F.abs(F.col("value") - (F.col("b") + F.col("m") * F.col("pixel"))) < tolerance
    x, y = F.when(inside, F.col("pixel")), F.when(inside, F.col("value"))
    by = j.groupBy(axis).agg(F.count("*").alias("n"), F.count_if(inside).alias("inliers"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r2"))
    return by.where("inliers >= 2").select(axis, "inliers", r6(F.col("s")).alias("slope"), F.round("i", 4).alias("intercept"), r6(F.col("inliers") / F.col("n") * F.col("r2")).alias("confidence"))


def step_facts(values: DataFrame, axis: str, value: str) -> DataFrame:
    """An axis' sorted distinct values by their steps: even (all alike within a hundredth), ratios even, whole numbers, and a bar chart lying down (values spread twice as wide as they are many)."""
    v = values.select(axis, F.col(value).alias("v")).distinct()
    w = Window.partitionBy(axis).orderBy("v")
    s = v.withColumn("step", F.col("v") - F.lag("v").over(w)).withColumn("ratio", F.try_divide(F.col("v"), F.lag("v").over(w)))
    even = lambda c: F.max(c) - F.min(c) <= 0.01 * F.abs(F.avg(c))
    return s.groupBy(axis).agg(F.count("*").alias("n"), r6(F.avg("step")).alias("mean_step"), F.coalesce(even("step"), F.lit(False)).alias("even_steps"), F.coalesce(even("ratio"), F.lit(False)).alias("even_ratios"), F.bool_and(F.abs(F.col("v") - F.bround("v", 0)) < 0.01).alias("whole"))


def lying_bars(elements: DataFrame) -> DataFrame:
    """Whether a chart's bars lie down: their centres spread along y more than twice as wide as along x."""
    b = elements.where("element_type = 'bar'")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return b.groupBy("chart_id").agg(F.count("*").alias("bars"), (F.stddev_pop(cy) > 2 * F.stddev_pop(cx)).alias("horizontal"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def corners(paths: DataFrame, path: str, reach: int = 2, least: float = 45.0) -> DataFrame:
    """Points at which a path turns by `least` degrees or more between the points `reach` before and behind."""
    w = Window.partitionBy(path).orderBy("pos")
    p = paths.select(path, "pos", *((f(F.col(c), reach).over(w) - F.col(c)).alias(f"{n}{c}") for n, f in (("a", F.lag), ("b", F.lead)) for c in ("x", "y"))).where("ax IS NOT NULL AND bx IS NOT NULL")
    dot, cross = -(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")), F.col("ay") * F.col("bx") - F.col("ax") * F.col("by")
    turn = F.abs(F.degrees(F.atan2(cross, dot)))
    return p.select(path, "pos", F.round(turn, 4).alias("angle")).where(F.col("angle") >= least)
