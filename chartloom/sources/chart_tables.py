"""Tables of the extraction stage, derived from the base tables: tokens, elements, axes, charts, predictions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.tables import read

#: Size of a chart's image.
WIDTH, HEIGHT = 640, 400
CHART_TYPES = ("line", "bar", "pie", "scatter", "box", "area", "heatmap", "histogram")
LINE_SQL = "(l_linenumber::BIGINT * 1000000000000000 + l_partkey * 1000000 + l_suppkey)"


def line_place() -> Column:
    """A line's place in its order: its number, then part and supplier, since numbers repeat."""
    return F.col("l_linenumber").cast("long") * 10**15 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")


def pick(n: Column, of: tuple[str, ...]) -> Column:
    """The n-th text of a few, n modulo their number."""
    return F.element_at(F.array(*map(F.lit, of)), (F.pmod(n, F.lit(len(of))) + 1).cast("int"))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, chart_type, title, caption, context_text, difficulty): an order is a chart; one in six has no features."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("chart_id"), pick(F.col("o_orderkey"), CHART_TYPES).alias("chart_type"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("Totals of "), F.col("o_orderpriority"))).alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Figure "), F.col("o_orderkey").cast("string"), F.lit(": "), F.col("o_orderpriority"))).otherwise("").alias("caption"),
        F.when(F.col("o_orderkey") % 5 == 0, F.repeat(F.concat("o_orderpriority", F.lit(" ")), 40)).alias("context_text"), pick((F.col("o_orderkey") / 8).cast("long"), ("simple", "moderate", "complex")).alias("difficulty"),
        (F.col("o_orderkey") % 6 != 0).alias("has_features"), F.col("o_totalprice").alias("total"),
    )


CHARTS_SQL = f"""charts AS (SELECT o_orderkey AS chart_id, {list(CHART_TYPES)}[CAST(o_orderkey % 8 + 1 AS INT)] AS chart_type, CASE WHEN o_orderkey % 4 <> 0 THEN 'Totals of ' || o_orderpriority END AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Figure ' || o_orderkey || ': ' || o_orderpriority ELSE '' END AS caption, CASE WHEN o_orderkey % 5 = 0 THEN repeat(o_orderpriority || ' ', 40) END AS context_text,
    ['simple', 'moderate', 'complex'][CAST((o_orderkey // 8) % 3 + 1 AS INT)] AS difficulty, o_orderkey % 6 <> 0 AS has_features, o_totalprice AS total FROM orders)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, pos, text, role, confidence, x0, y0, x1, y1): a line of an order is a token; texts and roles follow the part."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    n, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey") % 9
    text = (
        F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("%"))).when(k == 2, F.concat(F.lit("Revenue "), F.col("l_returnflag"))).when(k == 3, F.concat("l_returnflag", "l_linestatus"))
        .when(k == 4, F.concat(F.lit("1,"), F.lpad(n, 3, "0"))).when(k == 5, F.concat(F.lit("Sales rate by month ("), F.col("l_returnflag"), F.lit(")"))).when(k == 6, "x").when(k == 7, F.concat(F.lit("1O"), n, F.lit(" K"))).otherwise("  ")
    )
    roles = ("y_tick", "X_TICK", "legend", "unknown", "data_label", "title", "", "y_axis_label", "x_axis_label")
    x0, y0 = F.col("l_partkey") * 37 % 560, (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 71) % 380
    placed = line.select(
        F.col("l_orderkey").alias("chart_id"), line_place().alias("pos"), text.alias("text"), F.nullif(pick(F.col("l_partkey"), roles), F.lit("")).alias("role"),
        F.round(0.3 + F.col("l_discount") * 7, 6).alias("confidence"), x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), (F.col("l_partkey") % 5 * 20 + 20).cast("long").alias("w"),
    )
    return placed.select("chart_id", "pos", "text", "role", "confidence", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 16).alias("y1"))


TOKENS_SQL = f"""tokens AS (SELECT *, x0 + w AS x1, y0 + 16 AS y1 FROM (SELECT l_orderkey AS chart_id, {LINE_SQL} AS pos,
    CASE l_partkey % 9 WHEN 0 THEN CAST(l_quantity AS INT)::VARCHAR WHEN 1 THEN CAST(l_quantity AS INT) || '%' WHEN 2 THEN 'Revenue ' || l_returnflag WHEN 3 THEN l_returnflag || l_linestatus
      WHEN 4 THEN '1,' || lpad(CAST(l_quantity AS INT)::VARCHAR, 3, '0') WHEN 5 THEN 'Sales rate by month (' || l_returnflag || ')' WHEN 6 THEN 'x' WHEN 7 THEN '1O' || CAST(l_quantity AS INT) || ' K' ELSE '  ' END AS text,
    nullif(['y_tick', 'X_TICK', 'legend', 'unknown', 'data_label', 'title', '', 'y_axis_label', 'x_axis_label'][CAST(l_partkey % 9 + 1 AS INT)], '') AS role,
    round(0.3::DOUBLE + l_discount * 7, 6) AS confidence, l_partkey * 37 % 560 AS x0, (l_suppkey * 53 + l_linenumber * 71) % 380 AS y0, l_partkey % 5 * 20 + 20 AS w FROM lineitem))"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, pos, element_type, r, g, b, x0, y0, x1, y1, confidence): a line of an order is an element as well; one in eleven has no colour."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount")
    coloured = F.col("l_partkey") % 11 != 0
    shade = lambda c: F.when(coloured, c.cast("int"))
    x0, y0 = F.col("l_partkey") * 29 % 560, (F.col("l_suppkey") * 41 + F.col("l_linenumber") * 31) % 340
    kind = F.when(F.col("l_returnflag") == "A", "bar").when(F.col("l_returnflag") == "N", "point").otherwise("slice")
    return line.select(
        F.col("l_orderkey").alias("chart_id"), line_place().alias("pos"), kind.alias("element_type"), shade(F.col("l_partkey") % 3 * 100).alias("r"), shade(F.col("l_suppkey") % 2 * 90).alias("g"), shade(F.lit(40)).alias("b"),
        x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), (x0 + 4 + F.col("l_partkey") % 70).cast("long").alias("x1"), (y0 + 4 + F.col("l_quantity").cast("int")).cast("long").alias("y1"), F.round(1 - F.col("l_discount") * 8, 6).alias("confidence"),
    )


ELEMENTS_SQL = f"""elements AS (SELECT *, x0 + 4 + pk % 70 AS x1, y0 + 4 + q AS y1 FROM (SELECT l_orderkey AS chart_id, {LINE_SQL} AS pos, l_partkey AS pk, CAST(l_quantity AS INT) AS q,
    CASE l_returnflag WHEN 'A' THEN 'bar' WHEN 'N' THEN 'point' ELSE 'slice' END AS element_type, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey % 3 * 100 AS INT) END AS r, CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_suppkey % 2 * 90 AS INT) END AS g,
    CASE WHEN l_partkey % 11 <> 0 THEN 40 END AS b, l_partkey * 29 % 560 AS x0, (l_suppkey * 41 + l_linenumber * 31) % 340 AS y0, round(1 - l_discount * 8, 6) AS confidence FROM lineitem))"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, x_min, x_max, y_min, y_max, x_conf, y_conf): bounds of an order's axes; some are unknown."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("chart_id"), F.when(key % 7 != 0, F.lit(0.0)).alias("x_min"), F.when(key % 5 != 0, (F.col("o_custkey") % 50 + 1).cast("double")).alias("x_max"), (key % 3).cast("double").alias("y_min"), F.floor("o_totalprice").cast("double").alias("y_max"),
        F.round((key % 10).cast("double") / 10, 2).alias("x_conf"), F.round((F.col("o_custkey") % 7).cast("double") / 7, 3).alias("y_conf"),
    )


AXES_SQL = """axes AS (SELECT o_orderkey AS chart_id, CASE WHEN o_orderkey % 7 <> 0 THEN 0.0::DOUBLE END AS x_min, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 50 + 1)::DOUBLE END AS x_max, (o_orderkey % 3)::DOUBLE AS y_min, floor(o_totalprice)::DOUBLE AS y_max,
    round((o_orderkey % 10)::DOUBLE / 10, 2) AS x_conf, round((o_custkey % 7)::DOUBLE / 7, 3) AS y_conf FROM orders)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts as an extraction saw them: (chart_id, pred_type, seconds, overall, failed); one in thirteen is missing."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").where("o_orderkey % 13 <> 0")
    key = F.col("o_orderkey")
    seen = F.when(key % 9 == 0, "unknown").when(key % 4 == 1, "grouped_bar").otherwise(pick(key + (F.col("o_custkey") % 5 == 0).cast("int"), CHART_TYPES))
    return o.select(key.alias("chart_id"), seen.alias("pred_type"), (F.col("o_totalprice") / 99991).alias("seconds"), F.round((F.col("o_custkey") % 100).cast("double") / 100, 2).alias("overall"), (key % 17 == 0).alias("failed"))


PREDICTED_SQL = f"""predicted AS (SELECT o_orderkey AS chart_id, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 1 THEN 'grouped_bar'
      ELSE {list(CHART_TYPES)}[CAST((o_orderkey + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END) % 8 + 1 AS INT)] END AS pred_type,
    o_totalprice / 99991 AS seconds, round((o_custkey % 100)::DOUBLE / 100, 2) AS overall, o_orderkey % 17 = 0 AS failed FROM orders WHERE o_orderkey % 13 <> 0)"""
