"""Tokens, elements and detections of charts: filters, roles, ticks, plausibility, rule classification. All pairwise work stays within one chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import numeric as N

#: Words that a label of an axis, or of a legend, contains.
AXIS_WORDS = (
    "count", "number", "amount", "value", "score", "rate", "ratio", "percentage", "percent", "frequency", "probability", "density", "time", "date", "year", "month", "day", "hour",
    "price", "cost", "revenue", "sales", "profit", "distance", "height", "width", "size", "area", "volume", "temperature", "weight", "mass", "speed", "velocity", "accuracy",
    "precision", "recall", "f1", "loss", "error", "epoch", "iteration", "step", "batch", "(", ")", "[", "]",
)
LEGEND_WORDS = (
    "group", "class", "category", "type", "series", "label", "train", "test", "val", "validation", "baseline", "proposed", "ours", "method", "model", "algorithm",
)
#: The element type that a chart type expects, and its axis template.
EXPECTED_ELEMENT = {"bar": "bar", "histogram": "bar", "line": "point", "scatter": "point", "area": "point", "pie": "slice", "box": "box", "heatmap": "cell"}


def r6(c: Column) -> Column:
    return F.round(c, 6)


def sure_tokens(tokens: DataFrame, least: float = 0.5, least_length: int = 1) -> DataFrame:
    """Tokens that are sure enough and long enough once stripped."""
    return tokens.where((F.col("confidence") >= least) & (F.length(F.trim("text")) >= least_length))


def context_tokens(tokens: DataFrame, most: int, least: float) -> DataFrame:
    """Of each chart's first `most` tokens those that are sure enough; the cap comes first."""
    place = F.row_number().over(Window.partitionBy("chart_id").orderBy("pos"))
    return tokens.withColumn("place", place).where(F.col("place") <= most).where(F.col("confidence") >= least).drop("place")


def best_detections(boxes: DataFrame, least: float = 0.5, least_area: int = 100, most: int = 50) -> DataFrame:
    """Boxes that are sure and large enough, the `most` surest of each image, numbered from 1; of equals the first."""
    kept = boxes.where((F.col("confidence") >= least) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("chart_id").orderBy(F.desc("confidence"), "pos"))).where(F.col("place") <= most)


def has_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def text_role(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int, text: Column, title_top: float = 0.15) -> Column:
    """The role of a token by its place and content; the first rule that holds decides."""
    rx, ry, wide = (x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width
    clean = F.trim(text)
    low, n = F.lower(clean), F.length(F.trim(text))
    numeric = F.replace(clean, F.lit(" "), F.lit("")).rlike(r"^[-+]?[\d,.]+%?$")
    number = numeric | clean.rlike(r"^[-+]?[\d,.]+\s*[%kKmMbB]?$")
    axis, legend = has_any(low, AXIS_WORDS), has_any(low, LEGEND_WORDS)
    first = F.left(clean, F.lit(1))
    title = (n > 10) & (first != F.lower(first)) & ~numeric
    within = lambda x, a, b: (x > a) & (x < b)
    return (
        F.when((ry < title_top) & within(rx, 0.15, 0.85) & (title | (wide > 0.3)), "title")
        .when((rx < 0.15) & within(ry, 0.25, 0.75) & (axis | (~numeric & (n > 3))), "y_axis_label")
        .when((rx < 0.25) & within(ry, 0.1, 0.9) & number, "y_tick")
        .when((ry > 0.85) & within(rx, 0.25, 0.75) & (axis | (~numeric & (n > 3))), "x_axis_label")
        .when((ry > 0.75) & (number | ((n < 20) & ~axis)), "x_tick")
        .when((rx > 0.65) & ((ry < 0.35) | (ry > 0.65)) & (legend | ((n < 25) & ~numeric)), "legend")
        .when(within(rx, 0.15, 0.85) & within(ry, 0.15, 0.85) & (number | (n < 15)), "data_label")
        .when(within(ry, 0.12, 0.25) & within(rx, 0.2, 0.8) & ~numeric, "subtitle")
        .otherwise("unknown")
    )


def role_ticks(tokens: DataFrame) -> DataFrame:
    """(chart_id, axis, pos, pixel, value): tokens whose role is a tick of an axis and whose text is a number, commas, blanks and percent signs aside, at their box's centre."""
    clean = F.replace(F.replace(F.replace("text", F.lit(","), F.lit("")), F.lit(" "), F.lit("")), F.lit("%"), F.lit(""))
    axis = F.when(F.lower("role") == "y_tick", "y").when(F.lower("role") == "x_tick", "x")
    pixel = F.when(axis == "y", (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    return tokens.select("chart_id", axis.alias("axis"), "pos", pixel.alias("pixel"), N.as_double(clean).alias("value")).where("axis IS NOT NULL AND value IS NOT NULL")


def band_ticks(tokens: DataFrame, width: int, height: int) -> DataFrame:
    """Numeric tokens by place: in the left fifth ticks of y, else in the lowest fifth ticks of x."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    axis = F.when(cx < width * 0.2, "y").when(cy > height * 0.8, "x")
    return tokens.select("chart_id", axis.alias("axis"), "pos", F.when(axis == "y", cy).otherwise(cx).alias("pixel"), N.parse_mapper(F.col("text")).alias("value")).where("axis IS NOT NULL AND value IS NOT NULL")


def loose_ticks(tokens: DataFrame, width: int, height: int) -> DataFrame:
    """(chart_id, axis, pos, pixel, value, label): the wider bands. Numbers in the left quarter are ticks of y; what lies in the lowest quarter, not far left, is a tick of x or, as a short text, a category."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    value, text = N.parse_demo(F.col("text")), F.trim("text")
    low = (cy >= height * 0.75) & (cx >= width * 0.1)
    rows = F.array(F.when((cx <= width * 0.25) & value.isNotNull(), F.struct(F.lit("y").alias("axis"), cy.alias("pixel"), value.alias("value"), F.lit(None).cast("string").alias("label"))), F.when(low & (value.isNotNull() | F.length(text).between(1, 29)), F.struct(F.lit("x").alias("axis"), cx.alias("pixel"), value.alias("value"), F.when(value.isNull(), text).alias("label"))))
    return tokens.select("chart_id", "pos", F.explode(F.array_compact(rows)).alias("t")).select("chart_id", "pos", "t.*")


def axis_calibrations(ticks: DataFrame) -> DataFrame:
    """(chart_id, axis) of at least two ticks: extremes of pixel and value, pixels a unit; categorical where only labels are; "insufficient_ticks" and "zero_range" say why not."""
    by = ticks.groupBy("chart_id", "axis").agg(F.count("value").alias("ticks"), F.count("label").alias("labels"), *(f(F.when(F.col("value").isNotNull(), F.col(c))).alias(f"{c}_{n}") for c in ("pixel", "value") for n, f in (("min", F.min), ("max", F.max))))
    numeric, flat = F.col("ticks") >= 2, F.abs(F.col("value_max") - F.col("value_min")) < 1e-10
    state = F.when(numeric & ~flat, "numeric").when(numeric, "zero_range").when((F.col("axis") == "x") & (F.col("labels") >= 2), "categorical").otherwise("insufficient_ticks")
    ok = state == "numeric"
    return by.select("chart_id", "axis", state.alias("state"), *(F.when(ok, F.col(c)).alias(c) for c in ("pixel_min", "pixel_max", "value_min", "value_max")), F.when(ok, r6(F.abs((F.col("pixel_max") - F.col("pixel_min")) / (F.col("value_max") - F.col("value_min"))))).alias("scale"))


def info_calibration(axes: DataFrame, width: Column, height: Column, margin: int = 50) -> DataFrame:
    """Both axes' ranges from known bounds: the plot lies `margin` from the image's edges, or on the whole of an image that leaves no room."""
    room = lambda size: F.when(size > 2 * margin, F.struct(F.lit(float(margin)).alias("from"), (size - margin).cast("double").alias("to"))).otherwise(F.struct(F.lit(0.0).alias("from"), size.cast("double").alias("to")))
    x, y = room(width), room(height)
    ready = lambda a: F.col(f"{a}_min").isNotNull() & F.col(f"{a}_max").isNotNull() & (F.col(f"{a}_min") != F.col(f"{a}_max"))
    axis = lambda a, p, flipped: F.when(ready(a), F.struct(F.lit(a).alias("axis"), p["from"].alias("pixel_min"), p["to"].alias("pixel_max"), F.col(f"{a}_min").alias("value_min"), F.col(f"{a}_max").alias("value_max"), F.lit(flipped).alias("inverted")))
    return axes.select("chart_id", F.explode(F.array_compact(F.array(axis("x", x, False), axis("y", y, True)))).alias("a")).select("chart_id", "a.*")


def clamped_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A box inside the image, a pixel wide and high at least."""
    a, b = F.least(F.greatest(x0, F.lit(0)), F.lit(width - 1)), F.least(F.greatest(y0, F.lit(0)), F.lit(height - 1))
    return a, b, F.least(F.greatest(x1, a + 1), F.lit(width)), F.least(F.greatest(y1, b + 1), F.lit(height))


def box_forms(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> Column:
    """A box as corner and size, as normalised centre and size, and its whole-pixel centre and area."""
    w, h = x1 - x0, y1 - y0
    return F.struct(w.alias("w"), h.alias("h"), F.floor((x0 + x1) / 2).cast("long").alias("cx"), F.floor((y0 + y1) / 2).cast("long").alias("cy"), (w * h).alias("area"), r6((x0 + x1) / 2 / width).alias("nx"), r6((y0 + y1) / 2 / height).alias("ny"), r6(w / width).alias("nw"), r6(h / height).alias("nh"))


def plot_values(elements: DataFrame, plot: tuple[int, int, int, int], low: float, high: float) -> DataFrame:
    """Elements with their centre as shares of the plot area, held to it, and a bar's value by its top edge."""
    x0, y0, x1, y1 = plot
    held = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    nx, ny = held(((F.col("x0") + F.col("x1")) / 2 - x0) / (x1 - x0)), held(1 - ((F.col("y0") + F.col("y1")) / 2 - y0) / (y1 - y0))
    top = held(1 - (F.col("y0") - y0) / (y1 - y0))
    return elements.select("chart_id", "pos", r6(nx).alias("nx"), r6(ny).alias("ny"), F.when(F.col("element_type") == "bar", r6(low + top * (high - low))).alias("bar_value"))


def valid_bar(w: Column, h: Column, image_area: int, least_aspect: float = 0.03, most_aspect: float = 30.0, least_area: int = 100, most_share: float = 0.5) -> Column:
    """Whether a box may be a bar: its aspect or the inverse in range, its area neither too small nor too large."""
    aspect = lambda a, b: (a / b).between(least_aspect, most_aspect)
    return (w > 0) & (h > 0) & (aspect(w, h) | aspect(h, w)) & (w * h >= least_area) & (w * h <= image_area * most_share)


def legend_swatch(x: Column, w: Column, h: Column, width: int) -> Column:
    """Whether a box is a legend's swatch: nearly square, and small on the right or tiny anywhere."""
    square = F.when(h > 0, w / h).otherwise(0.0).between(0.7, 1.4)
    return square & (((w * h < 800) & (x > width * 0.75)) | (w * h < 400))


def false_positive(width: Column, height: Column) -> Column:
    """Whether an image is hardly a chart: a side below 100 pixels, or an aspect beyond 5 or below a fifth."""
    return (width < 100) | (height < 100) | (width / height > 5) | (width / height < 0.2)


def remapped_type(element_type: Column, chart_type: Column) -> Column:
    """The type that an element has in a chart of this type."""
    return F.when((chart_type == "pie") & element_type.isin("bar", "point"), "slice").when(chart_type.isin("line", "scatter", "area") & (element_type == "bar"), "point").when(chart_type.isin("bar", "histogram") & (element_type == "point"), "bar").otherwise(element_type)


def runs_detector(detector: str, chart_type: Column) -> Column:
    """Whether a detector runs on charts of a type: bars not on lines, scatters, pies and areas; slices only on pies and unknown charts."""
    if detector == "bars":
        return ~chart_type.isin("line", "scatter", "pie", "area")
    return chart_type.isin("pie", "unknown") if detector == "slices" else F.lit(True)


def plausibility(charts: DataFrame, elements: DataFrame, width: int, height: int) -> DataFrame:
    """(chart_id, confidence, valid, issues): how well a chart's elements fit its type; each broken rule is an issue and lowers the confidence by its factor.

    A trend is what a line through the markers' centres explains by more than a half, or what is no steeper than noise.
    """
    bar, point, kind = F.col("element_type") == "bar", F.col("element_type") == "point", F.col("chart_type")
    w, base = F.col("x1") - F.col("x0"), F.col("y1")
    out = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > width) | (F.col("y1") > height)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    by = elements.groupBy("chart_id").agg(
        F.count_if(bar).alias("bars"), F.count_if(point).alias("points"), F.count_if(F.col("element_type") == "slice").alias("slices"), F.count_if(out).alias("outside"), F.stddev_pop(F.when(bar, w)).alias("sd"), F.avg(F.when(bar, w)).alias("mean"),
        (F.max(F.when(bar, base)) - F.min(F.when(bar, base))).alias("spread"), F.regr_r2(F.when(point, cy), F.when(point, cx)).alias("r2"), F.countDistinct(F.when(bar, F.col("x0"))).alias("xs"), F.countDistinct(F.when(bar, F.col("y0"))).alias("ys"),
    )
    j = charts.select("chart_id", "chart_type").join(by, "chart_id", "left").na.fill(0, ["bars", "points", "slices", "outside", "xs", "ys"])
    bars, points, slices = F.col("bars"), F.col("points"), F.col("slices")
    barred, lined = kind.isin("bar", "histogram"), kind.isin("line", "area")
    rules = [
        (barred & (bars == 0), "no bars", 0.5), (barred & (bars == 1), "one bar", 0.7), (barred & (bars >= 2) & (F.col("sd") > 0.5 * F.col("mean")), "bar widths differ", 0.9), (barred & (bars >= 2) & (F.col("spread") > height * 0.1), "baselines differ", 0.8),
        (lined & (points == 0) & (bars > 0), "bars, no markers", 0.6), (lined & (points >= 3) & (F.coalesce("r2", F.lit(1.0)) < 0.5), "no trend", 0.8), ((kind == "scatter") & (points < 5), "few points", 0.7), ((kind == "scatter") & (bars > 0), "bars in a scatter", 0.6),
        ((kind == "pie") & (slices == 0), "no slices", 0.4), ((kind == "box") & (bars < 2), "few boxes", 0.6), ((kind == "heatmap") & (bars > 0) & ((F.col("xs") < 2) | (F.col("ys") < 2)), "no grid", 0.7),
    ]
    nothing = bars + points + slices == 0
    factor = F.lit(1.0)
    for test, _, by_ in rules:
        factor = factor * F.when(test, by_).otherwise(1.0)
    factor = F.when(nothing, 0.1).otherwise(factor) * F.when(F.col("outside") > 0, 0.9).otherwise(1.0)
    issues = F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name, _ in rules), F.when(nothing, "no elements"), F.when(F.col("outside") > 0, F.concat(F.col("outside").cast("string"), F.lit(" out of bounds")))))
    return j.select("chart_id", r6(factor).alias("confidence"), ((F.size(issues) == 0) | (factor >= 0.5)).alias("valid"), issues.alias("issues"))


def rule_features(charts: DataFrame, elements: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row a chart with what the rule classifier looks at: counts, bar alignment, clustering of markers, round structure, shares of percent and of axis texts."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    kind = lambda k: F.col("element_type") == k
    by = elements.groupBy("chart_id").agg(F.count_if(kind("bar")).alias("bars"), F.count_if(kind("point")).alias("markers"), F.count_if(kind("slice")).alias("slices"), F.stddev_pop(F.when(kind("bar"), F.col("y1"))).alias("bottom_sd"), F.array_sort(F.collect_list(F.when(kind("bar"), F.col("x0").cast("double")))).alias("lefts"), F.collect_list(F.when(kind("point"), F.struct(cx.alias("x"), cy.alias("y")))).alias("at"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("lefts") - 1, F.lit(1))), lambda i: F.get("lefts", i) - F.get("lefts", i - 1))
    mean = lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))
    sd = lambda xs, m: F.sqrt(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(xs)))
    by = by.withColumn("steps", F.when(F.size("lefts") > 2, steps)).withColumn("step_mean", mean(F.col("steps"))).withColumn("spacing", F.when(F.size("lefts") > 2, sd(F.col("steps"), F.col("step_mean")) / (F.col("step_mean") + 1e-10)).otherwise(0.0))
    pairs = F.flatten(F.transform("at", lambda p, i: F.transform(F.slice("at", i + 2, F.greatest(F.size("at") - i - 1, F.lit(0))), lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))))
    by = by.withColumn("far", F.when(F.size("at") >= 3, pairs)).withColumn("far_mean", mean(F.col("far"))).withColumn("mx", mean(F.transform("at", lambda p: p["x"]))).withColumn("my", mean(F.transform("at", lambda p: p["y"])))
    by = by.withColumn("out", F.transform("at", lambda p: F.sqrt((p["x"] - F.col("mx")) * (p["x"] - F.col("mx")) + (p["y"] - F.col("my")) * (p["y"] - F.col("my"))))).withColumn("out_mean", mean(F.col("out")))
    texts = tokens.groupBy("chart_id").agg(F.count("*").alias("texts"), F.count_if(F.col("text").contains("%")).alias("percents"), F.count_if(F.lower("role").isin("x_tick", "y_tick", "x_axis_label", "y_axis_label")).alias("axis_texts"))
    j = charts.select("chart_id").join(by, "chart_id", "left").join(texts, "chart_id", "left").na.fill(0, ["bars", "markers", "slices", "texts", "percents", "axis_texts"])
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return j.select(
        "chart_id", "bars", "markers", "slices", F.when(F.col("bars") < 2, 0.0).otherwise(held(1 - F.least(F.lit(1.0), (F.col("bottom_sd") + F.col("spacing") * 100) / 100))).alias("aligned"), F.when(F.col("markers") < 3, 0.5).otherwise(F.least(F.lit(1.0), sd(F.col("far"), F.col("far_mean")) / (F.col("far_mean") + 1e-10))).alias("clustered"),
        F.when(F.col("slices") > 0, 1.0).when(F.col("markers") < 4, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - sd(F.col("out"), F.col("out_mean")) / (F.col("out_mean") + 1e-10))).alias("round"), F.when(F.col("texts") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("percents") / F.col("texts") * 2)).alias("percent"),
        F.when(F.col("texts") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("axis_texts") / F.greatest(F.lit(4), F.col("texts")))).alias("axis"),
    )


def rule_types(features: DataFrame, lines: Column | None = None, line_coverage: Column | None = None, least: float = 0.5) -> DataFrame:
    """The chart type of highest rule score, in the order bar, line, pie, scatter among equals; unknown below `least`."""
    lines, coverage = F.lit(0) if lines is None else lines, F.lit(0.0) if line_coverage is None else line_coverage
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    on = lambda test, x: F.when(test, x).otherwise(0.0)
    scores = {
        "bar": held(on(F.col("bars") >= 2, 0.4) + 0.3 * F.col("aligned") + 0.2 * F.col("axis") - on((lines > 0) & (F.col("bars") == 0), 0.3)),
        "line": held(on(lines > 0, 0.4) + 0.3 * coverage + 0.2 * F.col("axis") - on(F.col("bars") > 3, 0.3)),
        "pie": held(on(F.col("slices") > 0, 0.5) + 0.3 * F.col("round") + 0.2 * F.col("percent") - on(F.col("axis") > 0.5, 0.2)),
        "scatter": held(on(F.col("markers") >= 5, 0.4) + on((F.col("markers") > 0) & (F.col("clustered") < 0.5), 0.3) + 0.2 * F.col("axis") - on((lines > 0) & (F.col("markers") > 0), 0.2)),
    }
    scored = features.select("chart_id", *(F.round(v, 9).alias(k) for k, v in scores.items()))
    best = F.greatest(*scores)
    return scored.select("chart_id", F.when(best < least, "unknown").when(F.col("bar") == best, "bar").when(F.col("line") == best, "line").when(F.col("pie") == best, "pie").otherwise("scatter").alias("chart_type"), r6(best).alias("confidence"))


def likely_chart(scores: dict[str, Column], least: float = 0.4, most: int = 3) -> Column:
    """A struct of the mean of several scores, whether it is above `least`, and the `most` highest with their names, of equals in the given order."""
    mean = sum(scores.values()) / len(scores)
    ranked = F.array_sort(F.array(*(F.struct((-v).alias("v"), F.lit(k).alias("ord"), F.lit(name).alias("name")) for k, (name, v) in enumerate(scores.items()))))
    return F.struct(r6(mean).alias("score"), (mean > least).alias("is_chart"), F.array_join(F.transform(F.slice(ranked, 1, most), lambda x: F.concat_ws("=", x["name"], F.format_string("%.2f", -x["v"]))), ", ").alias("reason"))


def page_sizes(pages: DataFrame, least: int = 100, most: int = 4096, least_sharpness: float = 100.0) -> DataFrame:
    """Pages (page_id, width, height, sharpness): too small ones are rejected, too large ones get a smaller size, blurred ones only a warning."""
    small = (F.col("width") < least) | (F.col("height") < least)
    large = ~small & ((F.col("width") > most) | (F.col("height") > most))
    scaled = lambda c: F.when(large, F.floor(F.col(c) * (F.lit(float(most)) / F.greatest("width", "height"))).cast("long")).otherwise(F.col(c).cast("long"))
    notes = F.array_compact(F.array(F.when(small, "too small"), F.when(large, "resized"), F.when(~small & (F.col("sharpness") < least_sharpness), "low sharpness")))
    return pages.select("page_id", (~small).alias("kept"), F.when(~small, scaled("width")).alias("width"), F.when(~small, scaled("height")).alias("height"), F.array_join(notes, ",").alias("warnings"))
