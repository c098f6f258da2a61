"""Queries over series points."""

from __future__ import annotations

from chartloom.operators import insights as I
from chartloom.sources.tables import POINTS_SQL, series_points


def _over_points(op):
    return lambda spark, sf_dir: op(series_points(spark, sf_dir))


QUERIES = {
    "trend_per_series": _over_points(I.trends),
    "anomaly_points": _over_points(I.anomalies),
    "series_comparison": _over_points(I.comparisons),
    "half_split_trend": _over_points(I.half_split_trends),
    "share_distribution": _over_points(I.distributions),
    "insights_top5": _over_points(I.top_insights),
    "chart_validation_warnings": _over_points(I.validation_warnings),
    "session_totals": _over_points(I.session_totals),
    "flatten_points": _over_points(I.flattened),
}

_TREND = """trend AS (SELECT chart_id, series_name, series_idx, count(*) AS n, regr_slope(value, point_idx) AS slope, avg(value) AS mean, arg_min(value, point_idx) AS first, arg_max(value, point_idx) AS last
  FROM points GROUP BY ALL HAVING count(*) >= 3),
trends AS (SELECT chart_id, series_name, series_idx, n, round(slope, 6) AS slope, CASE WHEN slope / (abs(mean) + 1e-9) > 0.05 THEN 'increasing' WHEN slope / (abs(mean) + 1e-9) < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction,
  round(CASE WHEN abs(slope / (abs(mean) + 1e-9)) <= 0.05 THEN 0.7::DOUBLE ELSE least(0.9::DOUBLE, 0.5 + abs(slope / (abs(mean) + 1e-9))) END, 6) AS confidence, round((last - first) / (abs(first) + 1e-9) * 100, 6) AS pct_change FROM trend)"""
_ANOMALY = """anomalies AS (SELECT chart_id, series_name, series_idx, point_idx, label, value, round(z, 6) AS z, round(least(0.95::DOUBLE, 0.5 + z * 0.1), 6) AS confidence
  FROM (SELECT *, abs(value - mean) / sd AS z FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM points WINDOW w AS (PARTITION BY chart_id, series_name)) WHERE n >= 4 AND sd >= 1e-9) WHERE z > 2.0)"""
_COMPARE = """peaks AS (SELECT chart_id, series_name, series_idx, max(value) AS peak FROM points GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY peak DESC, series_idx) AS a, row_number() OVER (PARTITION BY chart_id ORDER BY peak, series_idx DESC) AS b FROM peaks),
comparisons AS (SELECT h.chart_id, h.series_name AS dominant, h.peak AS dominant_peak, l.series_name AS lowest, round(h.peak / (abs(l.peak) + 1e-9), 6) AS ratio FROM ranked h JOIN ranked l USING (chart_id) WHERE h.a = 1 AND l.b = 1 AND abs(h.peak) >= 1e-9)"""

ORACLES = {
    "trend_per_series": f"WITH {POINTS_SQL}, {_TREND} SELECT * FROM trends",
    "anomaly_points": f"WITH {POINTS_SQL}, {_ANOMALY} SELECT * FROM anomalies",
    "series_comparison": f"WITH {POINTS_SQL}, {_COMPARE} SELECT * FROM comparisons",
    "half_split_trend": f"""WITH {POINTS_SQL}, h AS (SELECT chart_id, series_name, series_idx, max(n) AS n, coalesce(avg(value) FILTER (point_idx < n // 2), 0.0) AS a, avg(value) FILTER (point_idx >= n // 2) AS b,
        min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM (SELECT *, count(*) OVER (PARTITION BY chart_id, series_name) AS n FROM points) GROUP BY ALL)
      SELECT chart_id, series_name, series_idx, n, CASE WHEN n < 2 THEN 'insufficient_data' WHEN n < 3 THEN 'unknown' WHEN b > a * 1.1::DOUBLE THEN 'increasing' WHEN b < a * 0.9::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend, low, high, mean, sd FROM h""",
    "share_distribution": f"""WITH {POINTS_SQL}, s AS (SELECT chart_id, series_name, series_idx, sum(value) AS v FROM points GROUP BY ALL), t AS (SELECT *, round(v / sum(v) OVER (PARTITION BY chart_id) * 100, 6) AS share FROM s)
      SELECT chart_id, count(*) AS segments, sum(share) BETWEEN 95 AND 105 AS whole, first(series_name ORDER BY share DESC, series_idx) AS dominant, max(share) AS largest, first(series_name ORDER BY share, series_idx DESC) AS smallest, max(share) - min(share) < 10 AS even FROM t GROUP BY chart_id""",
    "insights_top5": f"""WITH {POINTS_SQL}, {_TREND}, {_ANOMALY}, {_COMPARE}, u AS (
        SELECT DISTINCT chart_id, 0 AS o, -1 AS series_idx, -1 AS point_idx, 'summary' AS kind, 0.6::DOUBLE AS confidence FROM points UNION ALL SELECT chart_id, 1, series_idx, -1, 'trend', confidence FROM trends
        UNION ALL SELECT chart_id, 2, -1, -1, 'comparison', 0.85::DOUBLE FROM comparisons WHERE chart_id IN (SELECT chart_id FROM points GROUP BY 1 HAVING count(DISTINCT series_idx) > 1) UNION ALL SELECT chart_id, 3, series_idx, point_idx, 'anomaly', confidence FROM anomalies)
      SELECT chart_id, rank, kind, series_idx, point_idx, confidence FROM (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY o, series_idx, point_idx) AS rank FROM u) WHERE rank <= 5""",
    "chart_validation_warnings": f"""WITH {POINTS_SQL}, r AS (SELECT chart_id, series_name, series_idx, count(*) AS n, count(*) FILTER (confidence < 0.5) AS low FROM points GROUP BY ALL)
      SELECT chart_id, series_name, series_idx, 0 AS rule_ord, 'low_confidence ' || low || '/' || n AS warning FROM r WHERE low > 0""",
    "session_totals": f"WITH {POINTS_SQL} SELECT chart_id % 10000 AS session, count(DISTINCT chart_id) AS charts, count(*) AS points, array_to_string(list_sort(list_distinct(list(series_name))), ',') AS series FROM points GROUP BY 1",
    "flatten_points": f"WITH {POINTS_SQL} SELECT CAST(chart_id AS VARCHAR) AS chart_id, CAST(series_idx AS VARCHAR) AS series_idx, series_name, CAST(point_idx AS VARCHAR) AS point_idx, CAST(label AS VARCHAR) AS label, printf('%.2f', value) AS value FROM points",
}
