"""Reshaping: linearised tables, unpivoting, paragraphs, page links, quality notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T

BREAK = "<0x0A>"


def parsed(tables: DataFrame, text: str) -> DataFrame:
    """tables with t, a struct(headers, rows), in place of a linearised table: lines split at BREAK, cells at the pipe.

    TITLE lines go. Header lines are those before the first line with a numeric cell, joined cell by cell;
    lines after need a pipe. Missing headers are col0, col1, ...; without a numeric line both are empty.
    Each step is a column of its own, lest its expression be evaluated once for each use.
    """
    keep = [c for c in tables.columns if c != text]
    strings, table = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    lines = F.filter(F.transform(F.split(F.replace(F.col(text), F.lit(BREAK), F.lit("\n")), "\n"), T.strip), lambda x: (x != "") & ~F.upper(x).startswith("TITLE"))
    out = tables.select(*keep, F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), T.strip)).alias("_cells"))
    out = out.select(*keep, "_cells", F.array_position(F.transform("_cells", lambda r: F.exists(r, N.is_number)), F.lit(True)).cast("int").alias("_n"))
    rows = F.when(F.col("_n") > 0, F.filter(F.slice("_cells", F.greatest("_n", F.lit(1)), F.size("_cells")), lambda r: F.size(r) > 1)).otherwise(table)
    head = F.aggregate(F.slice("_cells", 1, F.greatest(F.col("_n") - 1, F.lit(0))), strings, lambda acc, r: F.zip_with(acc, r, lambda a, b: F.trim(F.concat_ws(" ", a, b))))
    out = out.select(*keep, rows.alias("_rows"), head.alias("_head"))
    out = out.withColumn("_width", F.aggregate("_rows", F.lit(0), lambda acc, r: F.greatest(acc, F.size(r))))
    names = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_width") - 1, F.lit(0))), lambda i: F.coalesce(F.nullif(F.get("_head", i), F.lit("")), F.concat(F.lit("col"), i.cast("string"))))
    return out.select(*keep, F.struct(F.when(F.col("_width") > 0, names).otherwise(strings).alias("headers"), F.col("_rows").alias("rows")).alias("t"))


def _rows(tables: DataFrame, key: str) -> DataFrame:
    """(key, headers, row, cells) of parsed tables. The outer form, since before the plain one Spark filters by the array's size, which would parse each text anew."""
    return tables.select(key, "t.headers", F.posexplode_outer("t.rows").alias("row", "cells")).where("row IS NOT NULL")


def unpivot(tables: DataFrame, key: str) -> DataFrame:
    """Series points of parsed tables: the first column labels, each other one is a series; cells that are no number go."""
    rows = _rows(tables, key)
    values = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), N.parse_mapper)  # read before they are told apart, so that the filter below does not read them anew
    points = rows.select(key, "row", F.get("cells", F.lit(0)).alias("label"), "headers", F.posexplode_outer(values).alias("series_idx", "value")).where("value IS NOT NULL")
    return points.select(key, "series_idx", F.get("headers", F.col("series_idx") + 1).alias("series_name"), F.col("row").alias("point_idx"), "label", "value", F.lit(0.95).alias("confidence"))


def records(tables: DataFrame, key: str) -> DataFrame:
    """Rows as (header, cell) pairs, short rows padded with empty cells."""
    rows = _rows(tables, key)
    return rows.select(key, "row", F.posexplode_outer("headers").alias("col", "header"), "cells").where("col IS NOT NULL").select(key, "row", "col", "header", F.coalesce(F.get("cells", F.col("col")), F.lit("")).alias("cell"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Non-empty lines of each text, numbered from 0."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n"), T.strip), lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("pos", "paragraph"))


def with_context(paras: DataFrame, key: str, reach: int = 3, alt: str | None = None) -> DataFrame:
    """Each paragraph with the paragraphs within `reach` of it, itself left out: their number, their length, and the first caption among them, else its alternative text (column `alt`) if that is one."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-reach, reach)
    around = F.filter(F.collect_list(F.struct("pos", "paragraph")).over(w), lambda x: x["pos"] != F.col("pos"))
    other = F.when(T.caption(F.col(alt)), F.col(alt)) if alt else F.lit(None).cast("string")
    caption = F.coalesce(F.get(F.filter(F.col("around.paragraph"), T.caption), F.lit(0)), other)
    return paras.withColumn("around", around).select(key, "pos", F.size("around").alias("n"), F.length(F.array_join(F.col("around.paragraph"), " ")).alias("context_chars"), F.left(caption, F.lit(60)).alias("caption"))


def pseudo_pages(paras: DataFrame, key: str, each: int = 15) -> DataFrame:
    """Paragraphs dealt into pages of `each`, in order."""
    page = F.floor(F.col("pos") / each).cast("int")
    by = paras.groupBy(key, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))).alias("p"))
    return by.select(key, "page", F.size("p").alias("paragraphs"), F.md5(F.array_join(F.col("p.paragraph"), "\n")).alias("text_md5"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, number of links and first link of each page, by patterns."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))


def quality_notes(images: DataFrame) -> DataFrame:
    """Every failed rule of (image_id, width, height) as a note, and the quality score."""
    w, h = F.col("width"), F.col("height")
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    rules = ((w < 300, "width_small"), (h < 300, "height_small"), (w > 4096, "width_large"), (h > 4096, "height_large"), (aspect < 0.3, "aspect_small"), (aspect > 3.0, "aspect_large"))
    notes = F.array_compact(F.array(*(F.when(test, F.lit(note)) for test, note in rules)))
    score = 1.0 - F.size(notes) * 0.2 + F.least(w * h / 1e6, F.lit(1.0)) * 0.1 + F.when(aspect.between(0.8, 1.5), 0.1).otherwise(0.0)
    return images.select("image_id", F.array_join(notes, ",").alias("notes"), (F.size(notes) == 0).alias("valid"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9).alias("score"))
