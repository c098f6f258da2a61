"""Queries over tokens, elements and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import extraction as X
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import read

W, H = C.WIDTH, C.HEIGHT


def sure_tokens(spark, sf_dir):
    return X.sure_tokens(C.tokens(spark, sf_dir), 0.5, 2).select("chart_id", "pos", "text")


def context_tokens(spark, sf_dir):
    return X.context_tokens(C.tokens(spark, sf_dir), 3, 0.6).select("chart_id", "pos", "text", "confidence")


def best_detections(spark, sf_dir):
    return X.best_detections(C.elements(spark, sf_dir), 0.5, 400, 3).select("chart_id", "place", "pos", "confidence")


def text_roles(spark, sf_dir):
    t = C.tokens(spark, sf_dir)
    return t.select("chart_id", "pos", X.text_role(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), W, H, F.col("text")).alias("role"))


def role_ticks(spark, sf_dir):
    return X.role_ticks(C.tokens(spark, sf_dir))


def band_ticks(spark, sf_dir):
    return X.band_ticks(C.tokens(spark, sf_dir), W, H)


def axis_calibrations(spark, sf_dir):
    return X.axis_calibrations(X.loose_ticks(C.tokens(spark, sf_dir), W, H))


def info_calibration(spark, sf_dir):
    return X.info_calibration(C.axes(spark, sf_dir), (F.col("chart_id") % 300 + 10).cast("int"), F.lit(H))


def box_forms(spark, sf_dir):
    e = C.elements(spark, sf_dir).select("chart_id", "pos", *X.clamped_box(F.col("x0") - 30, F.col("y0") - 20, F.col("x1") + 25, F.col("y1") + 60, W, H))
    e = e.toDF("chart_id", "pos", "x0", "y0", "x1", "y1")
    return e.select("chart_id", "pos", "x0", "y0", X.box_forms(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), W, H).alias("b")).select("chart_id", "pos", "x0", "y0", "b.*")


def plot_values(spark, sf_dir):
    return X.plot_values(C.elements(spark, sf_dir), (60, 40, 601, 363), 0.0, 250.0)


def element_checks(spark, sf_dir):
    """What a box may be: a bar, a legend's swatch, an element remapped by its chart's type; and which detectors run."""
    e = C.elements(spark, sf_dir).join(C.charts(spark, sf_dir).select("chart_id", "chart_type"), "chart_id")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    new = X.remapped_type(F.col("element_type"), F.col("chart_type"))
    return e.select("chart_id", "pos", X.valid_bar(w, h, W * H, 0.2, 5.0, 300, 0.01).alias("bar"), X.legend_swatch(F.col("x0"), w, h, W).alias("swatch"), new.alias("element_type"), F.when(new != F.col("element_type"), F.col("element_type")).alias("original_type"), X.runs_detector("bars", F.col("chart_type")).alias("bars_run"), X.runs_detector("slices", F.col("chart_type")).alias("slices_run"))


def false_positives(spark, sf_dir):
    """Suspicious images of each class, uncertain ones left out."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 900 + 60).alias("w"), (F.col("p_size") * 12 + 50).alias("h"), C.pick(F.col("p_partkey"), (*C.CHART_TYPES, "uncertain")).alias("cls"))
    return p.where("cls <> 'uncertain'").groupBy("cls").agg(F.count("*").alias("n"), F.count_if(X.false_positive(F.col("w"), F.col("h"))).alias("suspicious"))


def plausibility(spark, sf_dir):
    return X.plausibility(C.charts(spark, sf_dir), C.elements(spark, sf_dir).where("chart_id % 5 <> 4"), 600, 360).withColumn("issues", F.array_join("issues", ","))


def rule_features(spark, sf_dir):
    f = X.rule_features(C.charts(spark, sf_dir), C.elements(spark, sf_dir), C.tokens(spark, sf_dir))
    return f.select("chart_id", "bars", "markers", "slices", *(X.r6(F.col(c)).alias(c) for c in ("aligned", "clustered", "round", "percent", "axis")))


def rule_types(spark, sf_dir):
    f = X.rule_features(C.charts(spark, sf_dir), C.elements(spark, sf_dir), C.tokens(spark, sf_dir))
    return X.rule_types(f, F.when(F.col("chart_id") % 3 == 0, 1).otherwise(0), F.when(F.col("chart_id") % 3 == 0, 0.8).otherwise(0.0))


def likely_charts(spark, sf_dir):
    """Six scores of each part as an image."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    part = lambda k: F.pmod(F.col("p_partkey") * k, F.lit(101)).cast("double") / 101.5
    s = {n: part(k) for n, k in (("has_axes", 3), ("has_grid", 5), ("has_bars", 7), ("has_text", 11), ("color_distribution", 13), ("edge_density", 17))}
    return p.select("p_partkey", X.likely_chart(s).alias("x")).select("p_partkey", "x.*")


def page_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_partkey") * 17 % 6000 + 40).alias("width"), (F.col("p_size") * 110 + 30).alias("height"), (F.col("p_retailprice") % 300).alias("sharpness"))
    return X.page_sizes(p)


def element_map(spark, sf_dir):
    """Charts by the element type their own type expects, as a lookup in a map of constants."""
    kinds = F.create_map(*(F.lit(x) for kv in X.EXPECTED_ELEMENT.items() for x in kv))
    return C.charts(spark, sf_dir).groupBy(F.coalesce(F.try_element_at(kinds, F.col("chart_type")), F.lit("unknown")).alias("expected")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (sure_tokens, context_tokens, best_detections, text_roles, role_ticks, band_ticks, axis_calibrations, info_calibration, box_forms, plot_values, element_checks, false_positives, plausibility, rule_features, rule_types, likely_charts, page_sizes, element_map)}

_T, _E, _CH = f"WITH {C.TOKENS_SQL}", f"WITH {C.ELEMENTS_SQL}", C.CHARTS_SQL
_NUM = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
_DOUBLE = lambda c: f"CASE WHEN regexp_matches({c}, {_NUM}) THEN TRY_CAST({c} AS DOUBLE) END"
_TIMES = lambda c: f"CASE lower(right({c}, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END"
_MAPPER = f"({_DOUBLE('''replace(translate(regexp_replace(trim(text), '[%kKmMbB]$', ''), 'OlI', '011'), ',', '')''')}) * {_TIMES('trim(text)')}"
_DEMO_TEXT = "trim(regexp_replace(regexp_replace(trim(text), '^[$£€¥]+', ''), '%$', ''))"
_DEMO = f"({_DOUBLE(f'''trim(replace(regexp_replace({_DEMO_TEXT}, '[kKmMbB]$', ''), ',', ''))''')}) * {_TIMES(_DEMO_TEXT)}"
_ANY = lambda ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"
_FEATURES = f"""{_CH}, {C.ELEMENTS_SQL}, {C.TOKENS_SQL}, c2 AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM elements),
  b AS (SELECT chart_id, count(*) FILTER (element_type = 'bar') AS bars, count(*) FILTER (element_type = 'point') AS markers, count(*) FILTER (element_type = 'slice') AS slices, stddev_pop(y1) FILTER (element_type = 'bar') AS bottom_sd FROM c2 GROUP BY 1),
  st AS (SELECT chart_id, x0 - lag(x0) OVER (PARTITION BY chart_id ORDER BY x0) AS s FROM c2 WHERE element_type = 'bar'), sp AS (SELECT chart_id, stddev_pop(s) / (avg(s) + 1e-10) AS spacing, count(s) AS n FROM st GROUP BY 1),
  pr AS (SELECT p.chart_id, sqrt((p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy)) AS d FROM c2 p JOIN c2 q ON p.chart_id = q.chart_id AND p.pos < q.pos AND p.element_type = 'point' AND q.element_type = 'point'),
  cl AS (SELECT chart_id, stddev_pop(d) / (avg(d) + 1e-10) AS cv FROM pr GROUP BY 1), mid AS (SELECT chart_id, avg(cx) AS mx, avg(cy) AS my FROM c2 WHERE element_type = 'point' GROUP BY 1),
  ro AS (SELECT chart_id, stddev_pop(d) / (avg(d) + 1e-10) AS cv FROM (SELECT c2.chart_id, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) AS d FROM c2 JOIN mid USING (chart_id) WHERE element_type = 'point') GROUP BY 1),
  tx AS (SELECT chart_id, count(*) AS texts, count(*) FILTER (contains(text, '%')) AS percents, count(*) FILTER (lower(role) IN ('x_tick', 'y_tick', 'x_axis_label', 'y_axis_label')) AS axis_texts FROM tokens GROUP BY 1),
  features AS (SELECT c.chart_id, coalesce(bars, 0) AS bars, coalesce(markers, 0) AS markers, coalesce(slices, 0) AS slices, CASE WHEN coalesce(bars, 0) < 2 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, 1 - least(1.0, (bottom_sd + CASE WHEN bars > 2 THEN spacing ELSE 0 END * 100) / 100))) END AS aligned,
    CASE WHEN coalesce(markers, 0) < 3 THEN 0.5::DOUBLE ELSE least(1.0, cl.cv) END AS clustered, CASE WHEN slices > 0 THEN 1.0::DOUBLE WHEN coalesce(markers, 0) < 4 THEN 0.0 ELSE greatest(0.0, 1 - ro.cv) END AS round,
    CASE WHEN coalesce(texts, 0) = 0 THEN 0.0::DOUBLE ELSE least(1.0, percents::DOUBLE / texts * 2) END AS percent, CASE WHEN coalesce(texts, 0) = 0 THEN 0.0::DOUBLE ELSE least(1.0, axis_texts::DOUBLE / greatest(4, texts)) END AS axis
    FROM charts c LEFT JOIN b USING (chart_id) LEFT JOIN sp USING (chart_id) LEFT JOIN cl USING (chart_id) LEFT JOIN ro USING (chart_id) LEFT JOIN tx USING (chart_id))"""
_PLAUSIBLE = (
    ("barred AND bars = 0", "no bars", 0.5), ("barred AND bars = 1", "one bar", 0.7), ("barred AND bars >= 2 AND sd > 0.5 * mean", "bar widths differ", 0.9), ("barred AND bars >= 2 AND spread > 36.0", "baselines differ", 0.8), ("lined AND points = 0 AND bars > 0", "bars, no markers", 0.6),
    ("lined AND points >= 3 AND coalesce(r2, 1.0) < 0.5", "no trend", 0.8), ("chart_type = 'scatter' AND points < 5", "few points", 0.7), ("chart_type = 'scatter' AND bars > 0", "bars in a scatter", 0.6), ("chart_type = 'pie' AND slices = 0", "no slices", 0.4), ("chart_type = 'box' AND bars < 2", "few boxes", 0.6),
    ("chart_type = 'heatmap' AND bars > 0 AND (xs < 2 OR ys < 2)", "no grid", 0.7),
)
_LIKELY = (("has_axes", 3), ("has_grid", 5), ("has_bars", 7), ("has_text", 11), ("color_distribution", 13), ("edge_density", 17))
_HELD = lambda e: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e})), 9)"
ORACLES = {
    "sure_tokens": f"{_T} SELECT chart_id, pos, text FROM tokens WHERE confidence >= 0.5 AND length(trim(text)) >= 2",
    "context_tokens": f"{_T} SELECT chart_id, pos, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY pos) AS k FROM tokens) WHERE k <= 3 AND confidence >= 0.6",
    "best_detections": f"{_E}, k AS (SELECT chart_id, pos, confidence, row_number() OVER (PARTITION BY chart_id ORDER BY confidence DESC, pos) AS place FROM elements WHERE confidence >= 0.5 AND (x1 - x0) * (y1 - y0) >= 400) SELECT chart_id, place, pos, confidence FROM k WHERE place <= 3",
    "text_roles": rf"""{_T}, a AS (SELECT chart_id, pos, trim(text) AS t, lower(trim(text)) AS low, length(trim(text)) AS n, (x0 + x1)::DOUBLE / 2 / {W} AS rx, (y0 + y1)::DOUBLE / 2 / {H} AS ry, (x1 - x0)::DOUBLE / {W} AS wide FROM tokens),
      b AS (SELECT *, regexp_matches(replace(t, ' ', ''), '^[-+]?[\d,.]+%?$') AS numeric, regexp_matches(replace(t, ' ', ''), '^[-+]?[\d,.]+%?$') OR regexp_matches(t, '^[-+]?[\d,.]+\s*[%kKmMbB]?$') AS number, {_ANY(X.AXIS_WORDS)} AS axis, {_ANY(X.LEGEND_WORDS)} AS legend FROM a),
      c AS (SELECT *, n > 10 AND t[1:1] <> lower(t[1:1]) AND NOT numeric AS title FROM b)
      SELECT chart_id, pos, CASE WHEN ry < 0.15 AND rx > 0.15 AND rx < 0.85 AND (title OR wide > 0.3) THEN 'title' WHEN rx < 0.15 AND ry > 0.25 AND ry < 0.75 AND (axis OR (NOT numeric AND n > 3)) THEN 'y_axis_label' WHEN rx < 0.25 AND ry > 0.1 AND ry < 0.9 AND number THEN 'y_tick'
        WHEN ry > 0.85 AND rx > 0.25 AND rx < 0.75 AND (axis OR (NOT numeric AND n > 3)) THEN 'x_axis_label' WHEN ry > 0.75 AND (number OR (n < 20 AND NOT axis)) THEN 'x_tick' WHEN rx > 0.65 AND (ry < 0.35 OR ry > 0.65) AND (legend OR (n < 25 AND NOT numeric)) THEN 'legend'
        WHEN rx > 0.15 AND rx < 0.85 AND ry > 0.15 AND ry < 0.85 AND (number OR n < 15) THEN 'data_label' WHEN ry > 0.12 AND ry < 0.25 AND rx > 0.2 AND rx < 0.8 AND NOT numeric THEN 'subtitle' ELSE 'unknown' END AS role FROM c""",
    "role_ticks": f"{_T}, a AS (SELECT *, translate(text, ', %', '') AS c, CASE lower(role) WHEN 'y_tick' THEN 'y' WHEN 'x_tick' THEN 'x' END AS axis FROM tokens) SELECT * FROM (SELECT chart_id, axis, pos, CASE axis WHEN 'y' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS pixel, {_DOUBLE('c')} AS value FROM a) WHERE axis IS NOT NULL AND value IS NOT NULL",
    "band_ticks": f"{_T}, a AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM tokens), b AS (SELECT *, CASE WHEN cx < {W * 0.2} THEN 'y' WHEN cy > {H * 0.8} THEN 'x' END AS axis FROM a) SELECT * FROM (SELECT chart_id, axis, pos, CASE axis WHEN 'y' THEN cy ELSE cx END AS pixel, {_MAPPER} AS value FROM b) WHERE axis IS NOT NULL AND value IS NOT NULL",
    "axis_calibrations": f"""{_T}, a AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, {_DEMO} AS v, trim(text) AS t FROM tokens),
      k AS (SELECT chart_id, 'y' AS axis, cy AS pixel, v, NULL AS label FROM a WHERE cx <= {W * 0.25} AND v IS NOT NULL UNION ALL SELECT chart_id, 'x', cx, v, CASE WHEN v IS NULL THEN t END FROM a WHERE cy >= {H * 0.75} AND cx >= {W * 0.1} AND (v IS NOT NULL OR length(t) BETWEEN 1 AND 29)),
      g AS (SELECT chart_id, axis, count(v) AS ticks, count(label) AS labels, min(pixel) FILTER (v IS NOT NULL) AS p0, max(pixel) FILTER (v IS NOT NULL) AS p1, min(v) AS v0, max(v) AS v1 FROM k GROUP BY ALL),
      s AS (SELECT *, CASE WHEN ticks >= 2 AND abs(v1 - v0) >= 1e-10 THEN 'numeric' WHEN ticks >= 2 THEN 'zero_range' WHEN axis = 'x' AND labels >= 2 THEN 'categorical' ELSE 'insufficient_ticks' END AS state FROM g)
      SELECT chart_id, axis, state, CASE WHEN state = 'numeric' THEN p0 END AS pixel_min, CASE WHEN state = 'numeric' THEN p1 END AS pixel_max, CASE WHEN state = 'numeric' THEN v0 END AS value_min, CASE WHEN state = 'numeric' THEN v1 END AS value_max, CASE WHEN state = 'numeric' THEN round(abs((p1 - p0) / (v1 - v0)), 6) END AS scale FROM s""",
    "info_calibration": f"""WITH {C.AXES_SQL}, a AS (SELECT *, chart_id % 300 + 10 AS w FROM axes) SELECT chart_id, 'x' AS axis, CASE WHEN w > 100 THEN 50.0::DOUBLE ELSE 0.0 END AS pixel_min, CASE WHEN w > 100 THEN w - 50 ELSE w END::DOUBLE AS pixel_max, x_min AS value_min, x_max AS value_max, false AS inverted FROM a WHERE x_min <> x_max
      UNION ALL SELECT chart_id, 'y', 50.0, 350.0, y_min, y_max, true FROM a WHERE y_min <> y_max""",
    "box_forms": f"""{_E}, a AS (SELECT chart_id, pos, least(greatest(x0 - 30, 0), {W - 1}) AS x0, least(greatest(y0 - 20, 0), {H - 1}) AS y0, x1 + 25 AS p, y1 + 60 AS q FROM elements), b AS (SELECT chart_id, pos, x0, y0, least(greatest(p, x0 + 1), {W}) AS x1, least(greatest(q, y0 + 1), {H}) AS y1 FROM a)
      SELECT chart_id, pos, x0, y0, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, (x1 - x0) * (y1 - y0) AS area, round((x0 + x1) / 2 / {W}, 6) AS nx, round((y0 + y1) / 2 / {H}, 6) AS ny, round((x1 - x0) / {W}, 6) AS nw, round((y1 - y0) / {H}, 6) AS nh FROM b""",
    "plot_values": f"""{_E} SELECT chart_id, pos, round(least(greatest(((x0 + x1) / 2 - 60) / 541, 0.0), 1.0), 6) AS nx, round(least(greatest(1 - ((y0 + y1) / 2 - 40) / 323, 0.0), 1.0), 6) AS ny, CASE WHEN element_type = 'bar' THEN round(least(greatest(1 - (y0 - 40) / 323, 0.0), 1.0) * 250, 6) END AS bar_value FROM elements""",
    "element_checks": f"""WITH {_CH}, {C.ELEMENTS_SQL}, a AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM elements JOIN charts USING (chart_id)),
      b AS (SELECT *, CASE WHEN chart_type = 'pie' AND element_type IN ('bar', 'point') THEN 'slice' WHEN chart_type IN ('line', 'scatter', 'area') AND element_type = 'bar' THEN 'point' WHEN chart_type IN ('bar', 'histogram') AND element_type = 'point' THEN 'bar' ELSE element_type END AS new FROM a)
      SELECT chart_id, pos, w > 0 AND h > 0 AND (w / h BETWEEN 0.2 AND 5.0 OR h / w BETWEEN 0.2 AND 5.0) AND w * h >= 300 AND w * h <= {W * H * 0.01} AS bar, w / h BETWEEN 0.7 AND 1.4 AND ((w * h < 800 AND x0 > {W * 0.75}) OR w * h < 400) AS swatch, new AS element_type, CASE WHEN new <> element_type THEN element_type END AS original_type,
        chart_type NOT IN ('line', 'scatter', 'pie', 'area') AS bars_run, chart_type IN ('pie', 'unknown') AS slices_run FROM b""",
    "false_positives": f"""WITH p AS (SELECT p_partkey % 900 + 60 AS w, p_size * 12 + 50 AS h, {[*C.CHART_TYPES, 'uncertain']}[CAST(p_partkey % 9 + 1 AS INT)] AS cls FROM part) SELECT cls, count(*) AS n, count(*) FILTER (w < 100 OR h < 100 OR w / h > 5 OR w / h < 0.2) AS suspicious FROM p WHERE cls <> 'uncertain' GROUP BY 1""",
    "plausibility": f"""WITH {_CH}, {C.ELEMENTS_SQL}, a AS (SELECT *, element_type = 'bar' AS bar, element_type = 'point' AS point, x1 - x0 AS w, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM elements WHERE chart_id % 5 <> 4),
      g AS (SELECT chart_id, count(*) FILTER (bar) AS bars, count(*) FILTER (point) AS points, count(*) FILTER (element_type = 'slice') AS slices, count(*) FILTER (x0 < 0 OR y0 < 0 OR x1 > 600 OR y1 > 360) AS outside, stddev_pop(w) FILTER (bar) AS sd, avg(w) FILTER (bar) AS mean, max(y1) FILTER (bar) - min(y1) FILTER (bar) AS spread,
        regr_r2(cy, cx) FILTER (point) AS r2, count(DISTINCT x0) FILTER (bar) AS xs, count(DISTINCT y0) FILTER (bar) AS ys FROM a GROUP BY 1),
      j AS (SELECT c.chart_id, chart_type, coalesce(bars, 0) AS bars, coalesce(points, 0) AS points, coalesce(slices, 0) AS slices, coalesce(outside, 0) AS outside, sd, mean, spread, r2, coalesce(xs, 0) AS xs, coalesce(ys, 0) AS ys, chart_type IN ('bar', 'histogram') AS barred, chart_type IN ('line', 'area') AS lined FROM charts c LEFT JOIN g USING (chart_id)),
      f AS (SELECT chart_id, CASE WHEN bars + points + slices = 0 THEN 0.1::DOUBLE ELSE {" * ".join(f"CASE WHEN {t} THEN {k}::DOUBLE ELSE 1.0 END" for t, _, k in _PLAUSIBLE)} END * CASE WHEN outside > 0 THEN 0.9::DOUBLE ELSE 1.0 END AS k,
        concat_ws(',', {", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n, _ in _PLAUSIBLE)}, CASE WHEN bars + points + slices = 0 THEN 'no elements' END, CASE WHEN outside > 0 THEN outside || ' out of bounds' END) AS issues FROM j)
      SELECT chart_id, round(k, 6) AS confidence, issues = '' OR k >= 0.5 AS valid, issues FROM f""",
    "rule_features": f"WITH {_FEATURES} SELECT chart_id, bars, markers, slices, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("aligned", "clustered", "round", "percent", "axis")) + " FROM features",
    "rule_types": f"""WITH {_FEATURES}, l AS (SELECT *, chart_id % 3 = 0 AS lined FROM features), s AS (SELECT chart_id, {_HELD("CASE WHEN bars >= 2 THEN 0.4::DOUBLE ELSE 0 END + 0.3 * aligned + 0.2 * axis - CASE WHEN lined AND bars = 0 THEN 0.3::DOUBLE ELSE 0 END")} AS bar,
        {_HELD("CASE WHEN lined THEN 0.4::DOUBLE ELSE 0 END + 0.3::DOUBLE * CASE WHEN lined THEN 0.8::DOUBLE ELSE 0 END + 0.2 * axis - CASE WHEN bars > 3 THEN 0.3::DOUBLE ELSE 0 END")} AS line, {_HELD("CASE WHEN slices > 0 THEN 0.5::DOUBLE ELSE 0 END + 0.3 * round + 0.2 * percent - CASE WHEN axis > 0.5 THEN 0.2::DOUBLE ELSE 0 END")} AS pie,
        {_HELD("CASE WHEN markers >= 5 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN markers > 0 AND clustered < 0.5 THEN 0.3::DOUBLE ELSE 0 END + 0.2 * axis - CASE WHEN lined AND markers > 0 THEN 0.2::DOUBLE ELSE 0 END")} AS scatter FROM l), m AS (SELECT *, greatest(bar, line, pie, scatter) AS best FROM s)
      SELECT chart_id, CASE WHEN best < 0.5 THEN 'unknown' WHEN bar = best THEN 'bar' WHEN line = best THEN 'line' WHEN pie = best THEN 'pie' ELSE 'scatter' END AS chart_type, round(best, 6) AS confidence FROM m""",
    "likely_charts": f"""WITH s AS (SELECT p_partkey, unnest([{", ".join(f"{{'k': {i}, 'name': '{n}', 'v': (p_partkey * {k} % 101)::DOUBLE / 101.5}}" for i, (n, k) in enumerate(_LIKELY))}], recursive := true) FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, k) AS place FROM s)
      SELECT p_partkey, round(sum(v) / 6, 6) AS score, sum(v) / 6 > 0.4 AS is_chart, string_agg(name || '=' || printf('%.2f', v), ', ' ORDER BY place) FILTER (place <= 3) AS reason FROM r GROUP BY 1""",
    "page_sizes": """WITH p AS (SELECT p_partkey AS page_id, p_partkey * 17 % 6000 + 40 AS w, p_size * 110 + 30 AS h, p_retailprice % 300 AS s FROM part), a AS (SELECT *, w < 100 OR h < 100 AS small, w >= 100 AND h >= 100 AND (w > 4096 OR h > 4096) AS large FROM p)
      SELECT page_id, NOT small AS kept, CASE WHEN small THEN NULL WHEN large THEN CAST(floor(w * (4096.0::DOUBLE / greatest(w, h))) AS BIGINT) ELSE w END AS width, CASE WHEN small THEN NULL WHEN large THEN CAST(floor(h * (4096.0::DOUBLE / greatest(w, h))) AS BIGINT) ELSE h END AS height,
        concat_ws(',', CASE WHEN small THEN 'too small' END, CASE WHEN large THEN 'resized' END, CASE WHEN NOT small AND s < 100 THEN 'low sharpness' END) AS warnings FROM a""",
    "element_map": f"WITH {_CH} SELECT CASE chart_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EXPECTED_ELEMENT.items()) + " ELSE 'unknown' END AS expected, count(*) AS n FROM charts GROUP BY 1",
}
