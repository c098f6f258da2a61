"""Reports and label files as text columns, ready for write.text, and chat rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_lines(boxes: DataFrame, image: str, width: float, height: float, cls: Column | None = None) -> DataFrame:
    """A detector's label file of each image: class (0 if none is given) and normalised centre and size, six decimals, a box a line."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(0) if cls is None else cls, (F.col("x0") + F.col("x1")) / (2 * width), (F.col("y0") + F.col("y1")) / (2 * height), (F.col("x1") - F.col("x0")) / width, (F.col("y1") - F.col("y0")) / height)
    return boxes.groupBy(image).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("labels"))


def markdown_report(points: DataFrame, most_rows: int = 20) -> DataFrame:
    """One Markdown text a chart: a heading, and for each series a table of its first `most_rows` points."""
    row = F.concat(F.lit("| "), F.col("label").cast("string"), F.lit(" | "), F.format_string("%.2f", "value"), F.lit(" |"))
    series = points.groupBy("chart_id", "series_idx", "series_name").agg(F.array_sort(F.collect_list(F.struct("point_idx", row.alias("line")))).alias("rows"))
    shown = F.slice(F.col("rows.line"), 1, most_rows)
    more = F.when(F.size("rows") > most_rows, F.array(F.concat(F.lit("| ... | "), (F.size("rows") - most_rows).cast("string"), F.lit(" more |")))).otherwise(F.array().cast("array<string>"))
    block = F.concat(F.lit("## "), F.col("series_name"), F.lit("\n| label | value |\n|---|---|\n"), F.array_join(F.concat(shown, more), "\n"))
    charts = series.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("series_idx", block.alias("block")))).alias("blocks"))
    return charts.select("chart_id", F.concat(F.lit("# Chart "), F.col("chart_id").cast("string"), F.lit("\n"), F.array_join(F.col("blocks.block"), "\n")).alias("report"))


def html_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One text: an HTML table of a small result's rows in order, with & < > escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), *(cell(c) for c in columns), F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    return rows.agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("rows")).select(F.concat(F.lit("<table>" + head), F.array_join(F.col("rows.line"), ""), F.lit("</table>")).alias("html"))


def latex_rows(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """A LaTeX table row for each row, special characters escaped."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([&%$#_{}])", r"\\$1")
    return rows.select(key, F.concat(F.concat_ws(" & ", *(cell(c) for c in columns)), F.lit(r" \\")).alias("latex"))


def rendered(messages: Column, form: str, template: tuple[str, str, str] | None = None) -> Column:
    """An array of (role, content) as one text, in the chatml or llama3 form; "native" takes a model's own template: what stands before a role, between it and its content, and behind."""
    if form == "native" and template:
        a, b, c = template
        return F.aggregate(messages, F.lit(""), lambda acc, m: F.concat(acc, F.lit(a), m["role"], F.lit(b), m["content"], F.lit(c)))
    if form == "llama3":
        return F.concat(F.lit("<|begin_of_text|>"), F.aggregate(messages, F.lit(""), lambda acc, m: F.concat(acc, F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"), m["content"], F.lit("<|eot_id|>"))))
    if form == "chatml":
        return F.aggregate(messages, F.lit(""), lambda acc, m: F.concat(acc, F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    raise ValueError(f"unknown form {form!r}; known: chatml, llama3")


def dataset_yaml(classes: DataFrame, folder: str) -> DataFrame:
    """One text: a detector's dataset file over the classes (number, name) of a small table."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "name"))), lambda c: F.concat(F.lit("  "), c["number"].cast("string"), F.lit(": "), c["name"])), "\n")
    return classes.agg(F.concat(F.lit(f"path: {folder}\ntrain: images/train\nval: images/val\nnames:\n"), lines).alias("yaml"))


def benchmark_report(scores: DataFrame, suite: str) -> DataFrame:
    """One row: a suite's result as JSON and as a Markdown table, models by mean score, from (model, n, mean, errors) of a few models."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("k"), "model", "n", "mean", "errors")))
    row = lambda m: F.concat(F.lit("| "), m["model"], F.lit(" | "), m["n"].cast("string"), F.lit(" | "), F.format_string("%.4f", m["mean"]), F.lit(" | "), m["errors"].cast("string"), F.lit(" |"))
    by = scores.agg(ordered.alias("ms"))
    fields = F.transform("ms", lambda m: F.struct(m["model"].alias("model"), m["n"].alias("n"), m["errors"].alias("errors")))
    return by.select(F.to_json(F.struct(F.lit(suite).alias("suite"), fields.alias("models"))).alias("json"), F.concat(F.lit(f"# {suite}\n\n| Model | N | Mean | Errors |\n|---|---|---|---|\n"), F.array_join(F.transform("ms", row), "\n")).alias("markdown"))
