"""Merges of what several stages say of a chart: positional joins, corrections, fills and overwrites, and joins of blocks and texts. Each works by chart; nothing is compared across charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators.joins import likely


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def numbered_by(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def merged_points(mapped: DataFrame, reasoned: DataFrame) -> DataFrame:
    """Reasoned points (chart_id, series_ord, name, colour, point_ord, label, value, confidence), each with the value of the mapped point of the same place where that is surer; a chart without reasoned points keeps its mapped ones.

    Labels and colours that reasoning leaves empty come from the mapped side.
    """
    m = mapped.select("chart_id", "series_ord", "point_ord", *(F.col(c).alias(f"m_{c}") for c in ("name", "colour", "label", "value", "confidence")))
    m_series = mapped.groupBy("chart_id", "series_ord").agg(F.min("colour").alias("s_colour"))
    both = reasoned.join(m, ["chart_id", "series_ord", "point_ord"], "left").join(m_series, ["chart_id", "series_ord"], "left")
    surer = F.col("m_confidence") > F.col("confidence")
    label = F.when(surer & blank(F.col("label")), F.col("m_label")).otherwise(F.col("label"))
    out = both.select("chart_id", "series_ord", "name", F.coalesce("colour", "s_colour").alias("colour"), "point_ord", label.alias("label"), F.when(surer, F.col("m_value")).otherwise(F.col("value")).alias("value"), F.when(surer, F.col("m_confidence")).otherwise(F.col("confidence")).alias("confidence"))
    alone = mapped.join(reasoned.select("chart_id").distinct(), "chart_id", "left_anti").select(*out.columns)
    return out.unionByName(alone)


def legend_colours(tokens: DataFrame, elements: DataFrame) -> DataFrame:
    """(chart_id, place, label, hex): legend texts with the distinct colours of elements, matched by their order; a legend beyond the colours has none."""
    legends = numbered_by(tokens.where("role = 'legend'"), ["chart_id"], ["pos"], "place").select("chart_id", "place", F.col("text").alias("label"))
    first = elements.where("r IS NOT NULL").groupBy("chart_id", "r", "g", "b").agg(F.min("pos").alias("pos"))
    colours = numbered_by(first, ["chart_id"], ["pos"], "place").select("chart_id", "place", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    return legends.join(colours, ["chart_id", "place"], "left")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def rgb_of(hexa: Column) -> Column:
    part = lambda k: F.conv(F.substring(hexa, k, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def corrected_texts(tokens: DataFrame, corrections: DataFrame) -> DataFrame:
    """tokens with the text that the last correction (chart_id, ord, original, corrected) of it gives, and whether one did; corrections without an original are ignored."""
    last = corrections.where("original IS NOT NULL").groupBy("chart_id", F.col("original").alias("text")).agg(F.max_by("corrected", "ord").alias("corrected"))
    j = tokens.join(last, ["chart_id", "text"], "left")
    return j.select(*(F.coalesce("corrected", "text").alias("text") if c == "text" else F.col(c) for c in tokens.columns), F.col("corrected").isNotNull().alias("changed"))


def filled(old: DataFrame, new: DataFrame, key: str, fields: list[str], verified: str = "human-verified") -> DataFrame:
    """old with its empty fields filled from new; verified rows, and rows that new lacks, stay as they are. Filled rows are marked."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_there"))
    j = old.join(n, key, "left")
    open_ = F.col("_there").isNotNull() & ~(F.coalesce("annotator", F.lit("")) == verified)
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string").isin("", "0"))
    return j.select(key, *(F.when(open_ & empty(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.when(open_, "auto-prefilled").otherwise(F.col("annotator")).alias("annotator"))


def overwritten(old: DataFrame, new: DataFrame, key: str, fields: list[str], by: str) -> DataFrame:
    """old with every field that new has a value for; rows that new has are marked."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_there"))
    j = old.join(n, key, "left")
    return j.select(key, *(F.when(~blank(F.col(f"_{c}").cast("string")), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.when(F.col("_there"), by).otherwise(F.col("annotator")).alias("annotator"))


def vision_merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old (elements and axis structs, chart_type) with whole blocks of new: a given block replaces the old one, its missing fields taking defaults; a pie's axis is none."""
    n = new.select(key, F.col("elements").alias("_e"), F.col("axis").alias("_a"))
    j = old.join(n, key, "left")
    e, a = F.col("_e"), F.col("_a")
    elements = F.when(e.isNull(), F.col("elements")).otherwise(F.struct(F.coalesce(e["kind"], F.col("elements.kind"), F.lit("")).alias("kind"), F.coalesce(e["count"], F.lit(0)).alias("count"), F.coalesce(e["series"], F.lit(1)).alias("series")))
    axis = F.when(a.isNull(), F.col("axis")).when(F.col("chart_type") == "pie", F.lit(None)).otherwise(F.struct(F.coalesce(a["x_type"], F.lit("categorical")).alias("x_type"), F.coalesce(a["y_type"], F.lit("linear")).alias("y_type"), a["y_max"].alias("y_max")))
    return j.select(key, "chart_type", elements.alias("elements"), axis.alias("axis"))


def colour_points(elements: DataFrame) -> DataFrame:
    """Fallback points of charts without series: a series a colour, in order of appearance (no colour is black), a point an element, its value the centre's height, confidence 0.5."""
    c = elements.select("chart_id", "pos", *(F.coalesce(k, F.lit(0)).alias(k) for k in "rgb"), ((F.col("y0") + F.col("y1")) / 2).alias("value"))
    c = c.withColumn("first", F.min("pos").over(Window.partitionBy("chart_id", "r", "g", "b")))
    place = F.dense_rank().over(Window.partitionBy("chart_id").orderBy("first"))
    point = F.row_number().over(Window.partitionBy("chart_id", "first").orderBy("pos", "value"))
    return c.select("chart_id", F.concat(F.lit("Series "), place.cast("string")).alias("series"), hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"), F.concat(F.lit("Point "), point.cast("string")).alias("label"), "value", F.lit(0.5).alias("confidence"))


def described(charts: DataFrame, points: DataFrame) -> DataFrame:
    """A sentence about each chart: its type and title, its points and series, its axes' labels."""
    by = points.groupBy("chart_id").agg(F.count("*").alias("n"), F.countDistinct("series").alias("s"))
    j = charts.join(by, "chart_id", "left")
    head = F.concat(F.lit("This "), F.col("chart_type"), F.lit(" chart"), F.when(~blank(F.col("title")), F.concat(F.lit(' titled "'), F.col("title"), F.lit('"'))).otherwise(""))
    holds = F.when(F.col("n") > 0, F.concat(F.lit("contains "), F.col("n").cast("string"), F.lit(" data points across "), F.col("s").cast("string"), F.lit(" series")))
    axes = F.concat_ws(" and ", F.when(~blank(F.col("x_label")), F.concat(F.lit("x-axis showing "), F.col("x_label"))), F.when(~blank(F.col("y_label")), F.concat(F.lit("y-axis showing "), F.col("y_label"))))
    return j.select("chart_id", F.concat(F.concat_ws(". ", head, holds, F.when(axes != "", F.concat(F.lit("with "), axes))), F.lit(".")).alias("description"))


def described_briefly(charts: DataFrame, points: DataFrame) -> DataFrame:
    """A shorter sentence about each chart, each axis in a part of its own."""
    j = charts.join(points.groupBy("chart_id").agg(F.count("*").alias("n")), "chart_id", "left")
    head = F.concat(F.lit("A "), F.col("chart_type"), F.lit(" chart"), F.when(~blank(F.col("title")), F.concat(F.lit(' titled "'), F.col("title"), F.lit('"'))).otherwise(""))
    rest = (F.when(F.col("n") > 0, F.concat(F.lit("with "), F.col("n").cast("string"), F.lit(" data points"))), *(F.when(~blank(F.col(f"{a}_label")), F.concat(F.lit(f"{a}-axis: "), F.col(f"{a}_label"))) for a in "xy"))
    return j.select("chart_id", F.concat(F.concat_ws(". ", head, *rest), F.lit(".")).alias("description"))


#: What a chart of a type is called, and what is said of its elements.
TYPE_NAMES = {"scatter": "scatter plot", "histogram": "histogram", "heatmap": "heatmap", "box": "box plot"}
ELEMENT_TEXTS = {"bar": ("The chart contains ", " bars."), "pie": ("The chart has ", " segments."), "scatter": ("The chart displays ", " data points."), "histogram": ("The histogram shows ", " bins."), "box": ("The plot shows ", " box-and-whisker elements.")}


def described_fully(charts: DataFrame, elements: DataFrame, labels: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """A paragraph about each chart: kind and title, axes, elements by kind, trend and range, the largest segment, its labels, or their number beyond `most`.

    labels: (chart_id, pos, text); facts: (chart_id, trend, low, high, top_text, top_value, even), any of them null. Of a chart's labels only the first ones and their number are gathered.
    """
    kind = F.col("chart_type")
    called = F.coalesce(*(F.when(kind == k, v) for k, v in TYPE_NAMES.items()), F.concat(kind, F.lit(" chart")))
    quoted = lambda lead, c: F.when(~blank(F.col(c)), F.concat(F.lit(lead), F.col(c), F.lit("'")))
    order = Window.partitionBy("chart_id").orderBy("pos")
    first = labels.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy("chart_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), ", ").alias("shown"))
    counted = labels.groupBy("chart_id").agg(F.count("*").alias("n_labels")).join(first, "chart_id")
    j = charts.join(elements.groupBy("chart_id").agg(F.count("*").alias("n")), "chart_id", "left").join(counted, "chart_id", "left").join(facts, "chart_id", "left")
    title = F.when(blank(F.col("title")), ".").otherwise(F.concat(F.lit(" titled '"), F.col("title"), F.lit("'.")))
    axes = F.concat_ws(" and ", quoted("x-axis represents '", "x_label"), quoted("y-axis represents '", "y_label"))
    n = F.col("n").cast("string")
    of = F.coalesce(*(F.when(kind == k, F.concat(F.lit(a), n, F.lit(b))) for k, (a, b) in ELEMENT_TEXTS.items()), F.when(kind == "line", "The chart shows data points connected by lines."))
    trend = F.when(F.col("trend").isin("increasing", "decreasing", "stable"), F.concat(F.lit("The data shows "), F.when(F.col("trend") == "increasing", "an ").otherwise("a "), F.col("trend"), F.lit(" trend.")))
    span = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.concat(F.lit("Values range from "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string"), F.lit(".")))
    top = F.when(F.col("top_text").isNotNull(), F.concat(F.lit("The largest segment is "), F.col("top_text"), F.lit(" ("), F.col("top_value").cast("string"), F.lit("%).")))
    named = F.when(F.col("n_labels") <= most, F.concat(F.lit("Visible labels include: "), F.col("shown"), F.lit("."))).when(F.col("n_labels") > most, F.concat(F.lit("The chart contains "), F.col("n_labels").cast("string"), F.lit(" labeled data points.")))
    parts = (F.concat(F.lit("This is a "), called, title), F.when(axes != "", F.concat(F.lit("The "), axes, F.lit("."))), F.when(F.col("n") > 0, of), trend, span, top, F.when(F.col("even"), "The segments are relatively evenly distributed."), named)
    return j.select("chart_id", F.concat_ws(" ", *parts).alias("description"))


def complexity(elements: DataFrame, tokens: DataFrame) -> DataFrame:
    """Traits of each chart: dense beyond 20 elements, several series beyond two colours, legend and data labels among its texts."""
    e = elements.groupBy("chart_id").agg((F.count("*") > 20).alias("dense"), (F.countDistinct("r", "g", "b") > 2).alias("multi_series"), F.count("*").alias("elements"))
    t = tokens.groupBy("chart_id").agg(F.bool_or(F.coalesce(F.col("role") == "legend", F.lit(False))).alias("legend"), F.bool_or(F.coalesce(F.col("role") == "data_label", F.lit(False))).alias("data_labels"))
    return e.join(t, "chart_id", "left").na.fill(False)


def category_points(elements: DataFrame, labels: DataFrame, near: float = 50.0) -> DataFrame:
    """Each element with the category label nearest in x, of equals the leftmost: 0.9 sure within `near`, else 0.6."""
    j = elements.select("chart_id", "pos", ((F.col("x0") + F.col("x1")) / 2).alias("cx")).join(labels.select("chart_id", F.col("pixel").alias("px"), "label"), "chart_id")
    gap = F.abs(F.col("cx") - F.col("px"))
    by = j.groupBy("chart_id", "pos").agg(F.min_by(F.struct("label", gap.alias("gap")), F.struct(gap, "px", "label")).alias("m"))
    return by.select("chart_id", "pos", "m.label", F.when(F.col("m.gap") < near, 0.9).otherwise(0.6).alias("confidence"))


def captions_below(images: DataFrame, blocks: DataFrame, on: list[str], reach: int = 100) -> DataFrame:
    """Each image's caption: of the blocks whose top lies within `reach` below its bottom the first that reads "Figure 3: ...", else the first at all, 500 characters of it."""
    j = images.join(blocks, on).where((F.col("top") >= F.col("bottom")) & (F.col("top") <= F.col("bottom") + reach))
    numbered = F.col("text").rlike(r"(?i)(figure\s+\d+[.:]\s*.+|fig\.\s*\d+[.:]\s*.+|chart\s+\d+[.:]\s*.+)")
    by = j.groupBy(*on, "image").agg(F.min_by("text", F.when(numbered, F.col("block"))).alias("named"), F.min_by(F.left("text", F.lit(500)), "block").alias("first"))
    return images.select(*on, "image").join(by, [*on, "image"], "left").select(*on, "image", F.coalesce("named", "first").alias("caption"))


def context_above(images: DataFrame, blocks: DataFrame, on: list[str], reach: int = 200, most: int = 1000) -> DataFrame:
    """The texts of blocks that end within `reach` above an image's top, in order, `most` characters of them."""
    j = images.join(blocks, on).where((F.col("block_bottom") >= F.col("image_top") - reach) & (F.col("block_bottom") <= F.col("image_top")))
    return j.groupBy(*on, "image").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), " "), F.lit(most)).alias("context"))


def first_containing(files: DataFrame, papers: DataFrame, file: str, stem: str, key: str) -> DataFrame:
    """Each file with the first paper (by `ord`) whose key its stem contains: a stem's pieces of the lengths that keys have meet whole keys, so the join is on equality; pieces that are no key go by a bit map before it."""
    lengths = papers.select(F.length(key).alias("n")).distinct().agg(F.collect_list("n").alias("_lengths"))  # one row
    pieces = F.flatten(F.transform("_lengths", lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(stem) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(stem)), lambda i: F.substring(F.col(stem), i, n))))
    cut = files.crossJoin(F.broadcast(lengths)).select(file, F.explode(F.array_distinct(pieces)).alias("piece"))
    first = papers.groupBy(F.col(key).alias("piece")).agg(F.min("ord").alias("ord"))
    j = likely(cut, first, ["piece"]).join(first, "piece").groupBy(file).agg(F.min_by("piece", "ord").alias("paper"))
    return files.select(file).join(j, file, "left")


def best_error_rates(predicted: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Of each target text the least character error rate among its chart's predicted texts, 1 without any; lower case, stripped, empty ones left out."""
    # both sides lie in one sorted order, so that a task holds one sort: a join and its groups take two sorts and two hash maps
    t = targets.select(key, "pos", F.lower(F.trim("text")).alias("t")).where("t <> ''")
    p = predicted.select(key, F.lower(F.trim("text")).alias("p")).where(f"p <> '' AND `{key}` IS NOT NULL")
    whole = Window.partitionBy(key).orderBy("pos", "t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = Window.partitionBy(key, "pos").orderBy("t")
    both = t.unionByName(p, allowMissingColumns=True).withColumn("ps", F.collect_set("p").over(whole)).where("t IS NOT NULL")
    least = F.array_min(F.transform("ps", lambda x: F.levenshtein(x, F.col("t"))))
    rates = both.select(key, "pos", "t", F.coalesce(F.round(least / F.length("t"), 6), F.lit(1.0)).alias("rate"))
    rates = rates.withColumn("n", F.row_number().over(each)).withColumn("cer", F.min("rate").over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rates.where("n = 1").select(key, "pos", "cer")


def found_by_role(targets: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """By role: target texts, and those of them that fuzzily match any predicted text of their chart."""
    p = predicted.select(key, F.lower(F.trim("text")).alias("p")).distinct()
    t = targets.select(key, "pos", F.coalesce("role", F.lit("unknown")).alias("role"), F.lower(F.trim("text")).alias("t"))
    j = t.join(p, key, "left").groupBy(key, "pos", "role").agg(F.bool_or(F.coalesce(T.fuzzy_match(F.col("t"), F.col("p")), F.lit(False))).alias("found"))
    return j.groupBy("role").agg(F.count("*").alias("n"), F.count_if("found").alias("found"))


def role_group(role: Column) -> Column:
    """The group that a role belongs to, by parts of its name."""
    r = F.coalesce(role, F.lit("other"))
    return F.when(r.contains("tick"), "tick_label").when(r.contains("axis_label"), "axis_label").when(r == "legend", "legend").when(r.contains("data_label"), "data_label").when(r == "title", "title").otherwise("other")


def free_places(placed: DataFrame, tries: DataFrame, key: str, gap: int) -> DataFrame:
    """Of each page's tries (ord, x, y, w, h) the first that keeps `gap` to all placed boxes of the page; pages without one are left out."""
    j = tries.join(placed.select(key, *(F.col(c).alias(f"p_{c}") for c in "xywh")), key, "left")
    apart = (F.col("x") + F.col("w") + gap < F.col("p_x")) | (F.col("x") > F.col("p_x") + F.col("p_w") + gap) | (F.col("y") + F.col("h") + gap < F.col("p_y")) | (F.col("y") > F.col("p_y") + F.col("p_h") + gap)
    ok = j.groupBy(key, "ord", "x", "y").agg(F.bool_and(F.coalesce(apart, F.lit(True))).alias("free")).where("free")
    return ok.groupBy(key).agg(F.min_by(F.struct("x", "y"), "ord").alias("at"), F.min("ord").alias("tried")).select(key, "tried", "at.x", "at.y")


def target_values(charts: DataFrame, points: DataFrame, ticks: DataFrame) -> DataFrame:
    """(chart_id, ord, value): what a perfect extraction would read, as texts: the title, each point's x and y, the ticks' labels."""
    title = charts.where("title IS NOT NULL AND title <> ''").select("chart_id", F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).alias("b")).alias("ord"), F.col("title").alias("value"))
    xy = points.select("chart_id", "pos", F.posexplode(F.array(F.col("x").cast("string"), F.col("y").cast("string"))).alias("b", "value")).where("value IS NOT NULL")
    xy = xy.select("chart_id", F.struct(F.lit(1).alias("part"), F.col("pos").alias("a"), "b").alias("ord"), "value")
    tick = ticks.select("chart_id", F.struct(F.lit(2).alias("part"), F.col("pos").alias("a"), F.lit(0).alias("b")).alias("ord"), F.col("text").alias("value"))
    return title.unionByName(xy).unionByName(tick)


def canonical_context(charts: DataFrame, tokens: DataFrame, elements: DataFrame, most_tokens: int = 5, least: float = 0.5, most_elements: int = 4) -> DataFrame:
    """One JSON text a chart: its type, the sure ones of its first tokens, and its first elements with centre and colour."""
    t = numbered_by(tokens, ["chart_id"], ["pos"], "n").where((F.col("n") < most_tokens) & (F.col("confidence") >= least))
    t = t.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", F.coalesce("role", F.lit("unknown")).alias("role")))).alias("t"))
    e = numbered_by(elements, ["chart_id"], ["pos"], "n").where(F.col("n") < most_elements)
    colour = F.when(F.col("r").isNotNull(), F.format_string("RGB(%d,%d,%d)", "r", "g", "b"))
    e = e.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("element_type").alias("type"), (F.col("x0") + F.col("x1")).alias("x2"), colour.alias("color")))).alias("e"))
    j = charts.select("chart_id", "chart_type").join(t, "chart_id", "left").join(e, "chart_id", "left")
    texts = F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["role"].alias("role")))
    shapes = F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["x2"].alias("x2"), x["color"].alias("color")))
    return j.select("chart_id", F.to_json(F.struct("chart_id", "chart_type", texts.alias("texts"), shapes.alias("elements"))).alias("payload"))
