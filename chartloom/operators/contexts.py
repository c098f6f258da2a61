"""The training-sample build: feature records, context lines, samples and their checks; one row a chart or a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles and their tags, in the order of a context's lines.
ROLE_TAGS = (("title", "TITLE"), ("subtitle", "TITLE"), ("x_axis_label", "X_LABEL"), ("y_axis_label", "Y_LABEL"), ("legend", "LEGEND"), ("x_tick", "X_TICKS"), ("y_tick", "Y_TICKS"), ("data_label", "DATA_LABELS"))
#: Question types of the first and the third stage, and each stage's system prompt.
FIRST_STAGE = ("structural", "layout", "element_count")
THIRD_STAGE = ("trend", "comparison", "why_reasoning", "interpolation", "percentage_change", "multi_hop", "prediction")
SYSTEM_PROMPTS = {
    1: "You are a chart structure expert. Describe the chart's visual structure accurately based on the provided metadata. Focus on layout, not values.",
    2: "You are a chart analysis expert. Answer questions about charts accurately based on the provided metadata. Provide exact numerical values when possible.",
    3: "You are a chart reasoning expert. Analyze trends, make comparisons, and draw insights from the chart data. Be analytical and precise.",
}


def feature_records(charts: DataFrame, tokens: DataFrame, elements: DataFrame, axes: DataFrame) -> DataFrame:
    """(chart_id, texts, elements, axis): what an extraction keeps of each chart, its lists in order; charts without any have empty lists."""
    texts = tokens.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "role", "confidence"))).alias("texts"))
    shapes = elements.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("pos", "element_type", "r", "g", "b", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")))).alias("elements"))
    out = charts.select("chart_id").join(texts, "chart_id", "left").join(shapes, "chart_id", "left").join(axes, "chart_id", "left")
    empty = lambda c, like: F.coalesce(c, F.filter(F.array(F.lit(None).cast(like.schema[c].dataType.elementType)), lambda x: F.lit(False)))
    return out.select("chart_id", empty("texts", texts).alias("texts"), empty("elements", shapes).alias("elements"), F.struct("x_min", "x_max", "y_min", "y_max", "x_conf", "y_conf").alias("axis"))


def most_common(xs: Column) -> Column:
    """The distinct values of an array with their counts, most frequent first, then by first place."""
    kinds = F.array_distinct(xs)
    counted = F.transform(kinds, lambda k: F.struct((-F.size(F.filter(xs, lambda x: x == k))).alias("n"), F.array_position(xs, k).alias("first"), k.alias("k")))
    return F.transform(F.array_sort(counted), lambda c: F.struct(c["k"].alias("k"), (-c["n"]).alias("n")))


def context_lines(charts: DataFrame, features: DataFrame, least_confidence: float = 0.30, most: int = 12) -> DataFrame:
    """(chart_id, context, features_used): the prompt's lines of each chart, from its features or else its caption and context.

    Texts by role, each once and `most` of a role; texts of unknown role where no other role is there; axes that are sure enough; counts of elements.
    """
    given = features.select("chart_id", F.filter(F.transform("texts", lambda t: F.struct(F.lower(F.coalesce(F.nullif(t["role"], F.lit("")), F.lit("unknown"))).alias("role"), F.trim(F.coalesce(t["text"], F.lit(""))).alias("text"))), lambda t: t["text"] != "").alias("named"), F.size("texts").alias("n_texts"), "elements", "axis")
    rows = charts.select("chart_id", "chart_type", "caption", "context_text").join(given.withColumn("featured", F.lit(True)), "chart_id", "left")
    of = lambda role: F.transform(F.filter("named", lambda t: t["role"] == role), lambda t: t["text"])
    known = F.exists("named", lambda t: t["role"].isin(*(r for r, _ in ROLE_TAGS)))
    line = lambda when, tag, text, feature: F.when(when, F.struct(F.concat(F.lit(f"[{tag}]: "), text).alias("line"), (F.lit(feature) if feature else F.lit(None).cast("string")).alias("feature")))
    bounds = lambda axis: F.concat(F.lit(f"{axis}=["), F.col(f"axis.{axis}_min").cast("string"), F.lit(", "), F.col(f"axis.{axis}_max").cast("string"), F.lit("] conf="), F.format_string("%.2f", f"axis.{axis}_conf"))
    sure = lambda axis: F.col(f"axis.{axis}_min").isNotNull() & F.col(f"axis.{axis}_max").isNotNull() & (F.col(f"axis.{axis}_conf") >= least_confidence)
    counts = F.array_join(F.transform(most_common(F.transform("elements", lambda e: F.coalesce(F.nullif(e["element_type"], F.lit("")), F.lit("unknown")))), lambda c: F.concat(c["k"], F.lit("="), c["n"].cast("string"))), ", ")
    parts = [
        line(F.lit(True), "CHART_TYPE", F.upper("chart_type"), ""),
        F.when(F.lit(True), F.struct(F.lit(None).cast("string").alias("line"), F.lit("stage3").alias("feature"))),
        *(line(F.size(of(role)) > 0, tag, F.array_join(F.slice(F.array_distinct(of(role)), 1, most), ", "), f"text_{role}") for role, tag in ROLE_TAGS),
        line((F.size(of("unknown")) > 0) & ~known, "OCR_TEXT", F.array_join(F.slice(of("unknown"), 1, 10), ", "), "ocr_fallback"),
        line(F.col("n_texts") == 0, "OCR_QUALITY", F.lit("low"), ""),
        F.when(sure("x"), F.struct(F.lit(None).cast("string").alias("line"), F.lit("axis_x").alias("feature"))),
        F.when(sure("y"), F.struct(F.lit(None).cast("string").alias("line"), F.lit("axis_y").alias("feature"))),
        line(sure("x") | sure("y"), "AXIS_INFO", F.concat_ws(" | ", F.when(sure("x"), bounds("x")), F.when(sure("y"), bounds("y"))), ""),
        line(F.size("elements") > 0, "ELEMENTS", counts, "elements"),
    ]
    caption, context = F.coalesce("caption", F.lit("")) != "", F.coalesce("context_text", F.lit("")) != ""
    without = [parts[0], line(caption, "CAPTION", F.left("caption", F.lit(200)), "caption"), line(context, "CONTEXT", F.left("context_text", F.lit(300)), "context_text"), line(~caption & ~context, "OCR_QUALITY", F.lit("unavailable"), "")]
    chosen = rows.select("chart_id", F.array_compact(F.when(F.col("featured"), F.array(*parts)).otherwise(F.array(*without))).alias("parts"))
    return chosen.select("chart_id", F.array_join(F.array_compact(F.col("parts.line")), "\n").alias("context"), F.array_compact(F.col("parts.feature")).alias("features_used"))


def curriculum_stage(question_type: Column) -> Column:
    kind = F.lower(F.coalesce(question_type, F.lit("")))
    return F.when(kind.isin(*FIRST_STAGE), 1).when(kind.isin(*THIRD_STAGE), 3).otherwise(2)


def training_samples(pairs: DataFrame, contexts: DataFrame, stage: int | None = None) -> DataFrame:
    """pairs (chart_id, qa_idx, chart_type, question, answer, question_type, difficulty, source) as (conversations, metadata), with the context of their chart.

    Pairs with a blank question or answer go; difficulty is 3 where none is given; optionally one curriculum stage stays.
    """
    kept = pairs.where((F.trim(F.coalesce("question", F.lit(""))) != "") & (F.trim(F.coalesce("answer", F.lit(""))) != "")).withColumn("stage", curriculum_stage(F.col("question_type")))
    kept = kept.where(F.col("stage") == stage) if stage else kept
    both = kept.join(contexts, "chart_id", "left")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = F.element_at(F.array(*(F.lit(SYSTEM_PROMPTS[k]) for k in (1, 2, 3))), F.col("stage"))
    used = F.coalesce("features_used", F.array().cast("array<string>"))
    talk = F.array(said("system", system), said("user", F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n[QUESTION]: "), F.trim("question"))), said("assistant", F.trim("answer")))
    meta = F.struct("question_type", F.col("stage").alias("curriculum_stage"), "chart_type", "chart_id", F.coalesce("difficulty", F.lit(3)).alias("difficulty"), "source", F.array_contains(used, "stage3").alias("has_stage3"), F.exists(used, lambda f: f.contains("axis")).alias("has_axis_info"), used.alias("features_used"))
    return both.select("chart_id", "qa_idx", talk.alias("conversations"), meta.alias("metadata"))


def sample_checks(samples: DataFrame, types: tuple[str, ...], least_question_types: int = 8) -> DataFrame:
    """One row (check, ok) for each condition on a sample set: not empty, all chart types there, question types enough, every structure whole."""
    turns = F.col("conversations")
    whole = (F.size(turns) == 3) & (F.get(turns, F.lit(0))["role"] == "system") & (F.get(turns, F.lit(1))["role"] == "user") & (F.get(turns, F.lit(2))["role"] == "assistant") & F.col("metadata.chart_id").isNotNull()
    facts = samples.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("metadata.chart_type").isin(*types), F.col("metadata.chart_type"))).alias("types"), F.countDistinct("metadata.question_type").alias("kinds"), F.count_if(~whole).alias("broken"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, types)), "types")), ",")
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail"))
    checks = F.array(row("not_empty", F.col("n") > 0, F.col("n").cast("string")), row("chart_types", F.size("types") == len(types), missing), row("question_types", F.col("kinds") >= least_question_types, F.col("kinds").cast("string")), row("structure", F.col("broken") == 0, F.col("broken").cast("string")))
    return facts.select(F.explode(checks).alias("x")).select("x.*")


def dataset_manifest(samples: DataFrame) -> DataFrame:
    """Rows (dimension, value, n): distributions of a sample set by chart type, question type, stage, and coverage flags, and the total."""
    m = F.col("metadata")
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in (("total", F.lit("all")), ("chart_type", m["chart_type"]), ("question_type", m["question_type"]), ("curriculum_stage", m["curriculum_stage"]), ("has_stage3", m["has_stage3"]), ("has_axis_info", m["has_axis_info"]))))
    return samples.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def source_metadata(items: DataFrame, kept: tuple[str, ...], extras: dict[str, tuple[str, ...]], dataset: str) -> DataFrame:
    """items with `metadata`, a map of the whitelisted columns and of the dataset's own extras, as texts; only values that say something (not null, empty, 0 or false) stay."""
    every = [*kept, *sorted({c for cs in extras.values() for c in cs})]
    wanted = lambda c: F.lit(True) if c in kept else F.col(dataset).isin(*(d for d, cs in extras.items() if c in cs))
    entries = F.array(*(F.when(wanted(c), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in every))
    says = F.filter(entries, lambda e: e.isNotNull() & e["value"].isNotNull() & ~e["value"].isin("", "0", "0.0", "false"))
    return items.withColumn("metadata", F.map_from_entries(says))
