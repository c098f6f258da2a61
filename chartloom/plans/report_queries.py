"""Queries that render reports, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import reports as P
from chartloom.plans.corpus_queries import _BOXES, _boxes
from chartloom.sources import files
from chartloom.sources.tables import POINTS_SQL, read, series_points


def yolo_label_lines(spark, sf_dir):
    return P.label_lines(_boxes(spark, sf_dir), "chart", 200.0, 200.0)


def markdown_reports(spark, sf_dir):
    return P.markdown_report(series_points(spark, sf_dir), 3).select("chart_id", F.md5("report").alias("report_md5"))


def latex_table_rows(spark, sf_dir):
    return P.latex_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "c_custkey")


def chat_rendering(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", F.md5(P.rendered(F.col("m"), "chatml")).alias("chatml_md5"), F.md5(P.rendered(F.col("m"), "llama3")).alias("llama3_md5"))


def latest_checkpoints(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("out/checkpoint-"), F.col("o_orderkey").cast("string")).alias("path"))
    return files.latest_checkpoint(p, "o_custkey", "path")


QUERIES = {f.__name__: f for f in (yolo_label_lines, markdown_reports, latex_table_rows, chat_rendering, latest_checkpoints)}

ORACLES = {
    "yolo_label_lines": f"WITH {_BOXES}, l AS (SELECT chart, printf('0 %.6f %.6f %.6f %.6f', (x0 + x1) / 400.0, (y0 + y1) / 400.0, (x1 - x0) / 200.0, (y1 - y0) / 200.0) AS line FROM boxes) SELECT chart, string_agg(line, chr(10) ORDER BY line) AS labels FROM l GROUP BY 1",
    "markdown_reports": f"""WITH {POINTS_SQL}, s AS (SELECT chart_id, series_idx, series_name, count(*) AS n, string_agg('| ' || label || ' | ' || printf('%.2f', value) || ' |', chr(10) ORDER BY point_idx) FILTER (point_idx < 3) AS body FROM points GROUP BY ALL),
      b AS (SELECT chart_id, series_idx, '## ' || series_name || chr(10) || '| label | value |' || chr(10) || '|---|---|' || chr(10) || body || CASE WHEN n > 3 THEN chr(10) || '| ... | ' || (n - 3) || ' more |' ELSE '' END AS block FROM s)
      SELECT chart_id, md5('# Chart ' || chart_id || chr(10) || string_agg(block, chr(10) ORDER BY series_idx)) AS report_md5 FROM b GROUP BY chart_id""",
    "latex_table_rows": r"SELECT c_custkey, regexp_replace(c_name, '([&%$#_{}])', '\\\1', 'g') || ' & ' || regexp_replace(c_mktsegment, '([&%$#_{}])', '\\\1', 'g') || ' \\' AS latex FROM customer",
    "chat_rendering": """SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS chatml_md5,
      md5('<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn)) AS llama3_md5 FROM conversations GROUP BY 1""",
    "latest_checkpoints": "SELECT o_custkey, 'out/checkpoint-' || max(o_orderkey) AS path FROM orders GROUP BY 1",
}
