"""Base tables and the chart-domain tables derived from them; each is a declared plan, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; Parquet gives pruned columns and pushed filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chart_id, series_name, series_idx, label, point_idx, value, confidence): a supplier's year is a chart, a return flag and line status a series, a month a point."""
    line = read(spark, sf_dir, "lineitem")
    points = line.groupBy(
        (F.col("l_suppkey") * 10000 + F.year("l_shipdate")).alias("chart_id"),
        F.concat("l_returnflag", "l_linestatus").alias("series_name"),
        F.month("l_shipdate").alias("label"),
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.round(1 - F.avg("l_discount") * 8, 6).alias("confidence"))
    chart, series = Window.partitionBy("chart_id"), Window.partitionBy("chart_id", "series_name")
    return points.withColumn("series_idx", F.dense_rank().over(chart.orderBy("series_name")) - 1).withColumn("point_idx", F.row_number().over(series.orderBy("label")) - 1)


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, qa_idx, question, answer, question_type, difficulty): a user turn and the assistant turn right after it."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    conv = read(spark, sf_dir, "conversations")
    both = conv.withColumn("answer", F.lead("text").over(turns)).withColumn("next_role", F.lead("role").over(turns))
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("counting", "trend", "comparison", "extraction", "reasoning"))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    return both.where("role = 'user' AND next_role = 'assistant'").select(
        "conv_id",
        F.col("turn").alias("qa_idx"),
        F.col("text").alias("question"),
        "answer",
        kinds.alias("question_type"),
        (F.pmod("conv_id", F.lit(5)) + 1).cast("int").alias("difficulty"),
    )


#: The same tables in DuckDB SQL, as common table expressions.
POINTS_SQL = """points AS (SELECT *, dense_rank() OVER (PARTITION BY chart_id ORDER BY series_name) - 1 AS series_idx,
    row_number() OVER (PARTITION BY chart_id, series_name ORDER BY label) - 1 AS point_idx
  FROM (SELECT l_suppkey * 10000 + year(l_shipdate) AS chart_id, l_returnflag || l_linestatus AS series_name, month(l_shipdate) AS label,
    round(sum(l_extendedprice), 2) AS value, round(1 - avg(l_discount) * 8, 6) AS confidence FROM lineitem GROUP BY 1, 2, 3))"""
QA_SQL = """qa AS (SELECT conv_id, turn AS qa_idx, text AS question, answer, ['counting', 'trend', 'comparison', 'extraction', 'reasoning'][CAST((conv_id + turn) % 5 + 1 AS INT)] AS question_type,
    CAST(conv_id % 5 + 1 AS INT) AS difficulty
  FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""
