"""Queries of smaller facts: pages, images, audits, paths, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T
from chartloom.operators import facts as X
from chartloom.operators import reports as P
from chartloom.plans.corpus_queries import _BOXES, _PATHS, _boxes, _paths
from chartloom.plans.rollup_queries import RESULTS_SQL, _FAILURES, _results
from chartloom.operators import rollup as R
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import QA_SQL, qa_pairs, read


def page_texts(spark, sf_dir):
    """Orders as pages, tokens as blocks, their type sizes by width."""
    b = C.tokens(spark, sf_dir).select((F.col("chart_id") % 97).alias("doc"), F.col("chart_id").alias("page"), F.col("pos").alias("block"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Figure "), F.col("text"))).otherwise(F.col("text")).alias("text"), (F.col("x1") - F.col("x0")).alias("size"))
    return X.page_texts(b, 50)


def image_notes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 97).alias("width"), (F.col("p_partkey") % 47 * 101).alias("height"), (F.col("p_partkey") % 40 / 40).alias("uniformity"), (F.col("p_partkey") % 300).alias("colours"))
    return X.image_notes(p)


def pixel_stats(spark, sf_dir):
    """Lines of a part as pixels of an image."""
    l = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_quantity") * 5).alias("r"), (F.col("l_suppkey") % 250).alias("g"), (F.col("l_linenumber") * 30).alias("b"))
    return X.pixel_stats(l, "l_partkey")


def score_report(spark, sf_dir):
    return X.score_report(read(spark, sf_dir, "events").select("event_type", (F.col("value") / 64).alias("score")), "event_type", "score")


def reason_histogram(spark, sf_dir):
    return X.reason_histogram(R.audit_rows(_results(spark, sf_dir)), "failures")


def feature_audit(spark, sf_dir):
    c = C.charts(spark, sf_dir).select("chart_id", "chart_type", "has_features").join(C.axes(spark, sf_dir).select("chart_id", F.col("x_max").isNotNull().alias("axis"), F.col("y_max").cast("long").alias("top")), "chart_id")
    e = C.elements(spark, sf_dir).groupBy("chart_id").agg(F.count("*").alias("elements"))
    return X.feature_audit(c.join(e, "chart_id", "left"), "chart_type", ["has_features", "axis"], ["elements", "top"])


def source_statistics(spark, sf_dir):
    """Documents, characters and labelled ones by source and by language."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    x = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in ("source", "lang"))))
    return d.select(x.alias("x"), "n_chars", "quality").groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"))


def slice_shares(spark, sf_dir):
    return X.slice_shares(C.elements(spark, sf_dir))


def profile_axis(spark, sf_dir):
    return X.profile_axis(C.elements(spark, sf_dir))


def adaptive_tolerance(spark, sf_dir):
    return X.adaptive_tolerance(_paths(spark, sf_dir), "path_id", 2.0)


def three_digits(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * N.power_of_ten(F.col("o_orderkey") % 13 - 10)).alias("v"))
    return o.select("o_orderkey", X.three_digits(F.when(F.col("o_orderkey") % 17 == 0, 0.0).when(F.col("o_orderkey") % 5 == 0, -F.col("v")).otherwise(F.col("v"))).alias("text"))


def scale_confidence(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/s")).alias("axis_id"), F.col("p_size").cast("double").alias("v"))
    t = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/t")).alias("axis_id"), F.pow(F.lit(10.0), (F.col("p_partkey") % 7).cast("double")).alias("v"))
    r = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/r")).alias("axis_id"), F.round("p_retailprice", 0).alias("v"))
    return X.scale_confidence(p.unionByName(t).unionByName(r), "axis_id", "v")


def contains_variants(spark, sf_dir):
    """Whole answers against the last sentence of their own (even conversations) or against the whole question; every fourth target is blank."""
    last = F.element_at(F.split("answer", r"[.!?][ \n]+"), -1)
    target = F.when(F.col("qa_idx") % 4 == 0, " ").when(F.col("conv_id") % 2 == 0, last).otherwise(F.col("question"))
    p = qa_pairs(spark, sf_dir).select("conv_id", "qa_idx", F.col("answer").alias("a"), target.alias("t"))
    return p.select("conv_id", "qa_idx", T.contains_match(F.col("a"), F.col("t")).alias("loose"), T.contains_answer(F.col("a"), F.col("t")).alias("strict"))


def field_types(spark, sf_dir):
    kinds = ("Stacked BAR", "column chart", "Histogram plot", "line", "curves", "Donut", "bubble", "heat map", "violin", "stack", "other", "pie")
    return read(spark, sf_dir, "part").groupBy(T.field_type(C.pick(F.col("p_partkey"), kinds)).alias("chart_type")).agg(F.count("*").alias("n"))


def detector_labels(spark, sf_dir):
    return P.label_lines(_boxes(spark, sf_dir), "chart", 200.0, 200.0, (F.col("box") % 3).cast("int"))


def detector_dataset(spark, sf_dir):
    return P.dataset_yaml(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("number"), F.col("r_name").alias("name")), "/data/charts")


def benchmark_report(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.count_if(F.col("value") < 5).alias("errors"))
    return P.benchmark_report(s, "events")


def region_table(spark, sf_dir):
    return P.html_table(read(spark, sf_dir, "region"), ["r_regionkey", "r_name"], "r_regionkey")


def native_rendering(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", F.md5(P.rendered(F.col("m"), "native", ("<|", "|>", "<end>"))).alias("native_md5"))


def audit_dimensions(spark, sf_dir):
    """Charts by split, type, difficulty and source version, with how many have features."""
    c = C.charts(spark, sf_dir).select("chart_type", "difficulty", "has_features", C.pick(F.col("chart_id"), ("train", "val", "test")).alias("split"), C.pick(F.col("chart_id") + 1, ("v1", "v2")).alias("version"))
    x = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in ("split", "chart_type", "difficulty", "version"))))
    return c.select(x.alias("x"), "has_features").groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.count_if("has_features").alias("covered"), F.round(F.avg(F.col("has_features").cast("int")) * 100, 6).alias("coverage"))


def api_projection(spark, sf_dir):
    """Charts as a service shows them: no texts, but whether they have any."""
    return C.charts(spark, sf_dir).select("chart_id", "chart_type", (F.coalesce("caption", F.lit("")) != "").alias("has_caption"), (F.coalesce("context_text", F.lit("")) != "").alias("has_context"), F.coalesce("title", F.lit("Untitled")).alias("title"))


def annotation_rows(spark, sf_dir):
    """Annotations as flat rows: counts of texts by role, and of elements."""
    roles = ("title", "legend", "data_label", "y_axis_label", "x_axis_label")
    t = C.tokens(spark, sf_dir).groupBy("chart_id").agg(F.count("*").alias("n_texts"), *(F.count_if(F.coalesce(F.col("role") == r, F.lit(False))).alias(f"n_{r}") for r in roles))
    c = C.charts(spark, sf_dir).select("chart_id", "chart_type", "difficulty")
    return c.join(t, "chart_id", "left").na.fill(0)


def reasoned_results(spark, sf_dir):
    """A model's JSON about a chart as series: points with confidence 0.9, colours out of triples."""
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit('{"title": "T'), n, F.lit('", "series": [{"name": "a", "color": [255, '), n, F.lit(', 0], "points": [{"label": "x", "value": '), n, F.lit('}, {"label": "y", "value": 2.5}]}, {"name": "b", "points": []}]}'))
    kind = "title string, series array<struct<name:string, color:array<int>, points:array<struct<label:string, value:double>>>>"
    p = read(spark, sf_dir, "part").select("p_partkey", F.from_json(text, kind).alias("j"))
    s = p.select("p_partkey", "j.title", F.posexplode("j.series").alias("series_idx", "s")).select("p_partkey", "title", "series_idx", "s.name", F.get("s.color", F.lit(1)).alias("green"), F.posexplode_outer("s.points").alias("point_idx", "p"))
    return s.select("p_partkey", "title", "series_idx", "name", "green", "point_idx", "p.label", "p.value", F.when(F.col("p").isNotNull(), 0.9).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        page_texts, image_notes, pixel_stats, score_report, reason_histogram, feature_audit, source_statistics, slice_shares, profile_axis, adaptive_tolerance, three_digits, scale_confidence, contains_variants, field_types, detector_labels, detector_dataset,
        benchmark_report, region_table, native_rendering, audit_dimensions, api_projection, annotation_rows, reasoned_results,
    )
}

_ROLES = ("title", "legend", "data_label", "y_axis_label", "x_axis_label")
_DIM = {"split": "['train', 'val', 'test'][CAST(chart_id % 3 + 1 AS INT)]", "chart_type": "chart_type", "difficulty": "difficulty", "version": "['v1', 'v2'][CAST((chart_id + 1) % 2 + 1 AS INT)]"}
_SCORE = "count(*) AS n, count(*) FILTER (value / 64 < 0.5) AS failed, round(avg((value / 64 < 0.5)::INT), 6) AS rate, round(avg(value / 64), 6) AS mean, round(stddev_pop(value / 64), 6) AS sd, min(value / 64) AS low, max(value / 64) AS high"
_NORMAL = r"regexp_replace(regexp_replace(lower({}), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '[\s\x0B]+', ' ', 'g')"
ORACLES = {
    "page_texts": rf"""WITH {C.TOKENS_SQL}, b AS (SELECT chart_id % 97 AS doc, chart_id AS page, pos AS block, CASE WHEN pos % 3 = 0 THEN 'Figure ' || text ELSE text END AS text, w AS size FROM tokens),
      c AS (SELECT doc, page, arg_max(text, length(text) * 100000000000000000::HUGEINT - block) AS caption FROM b WHERE regexp_matches(text, '(?i)^\s*(figure|fig\.?|chart|graph|table|plot|diagram|hình|biểu đồ)\s*\d*') GROUP BY ALL),
      t AS (SELECT doc, page, text FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY size DESC, text DESC) AS k FROM b) WHERE k = 1), j AS (SELECT doc, page, string_agg(text, ' ' ORDER BY block) AS text FROM b GROUP BY ALL)
      SELECT j.doc, j.page, CAST(length(j.text) AS INT) AS chars, length(trim(j.text)) < 40 AS is_scanned, caption[1:60] AS caption, t.text[1:60] AS title, md5(j.text[1:50]) AS text_md5 FROM j JOIN t USING (doc, page) LEFT JOIN c USING (doc, page)""",
    "image_notes": """WITH i AS (SELECT p_partkey AS image_id, p_size * 97 AS w, p_partkey % 47 * 101 AS h, p_partkey % 40 / 40 AS u, p_partkey % 300 AS c FROM part), a AS (SELECT *, CASE WHEN h > 0 THEN w / h ELSE 0 END AS r FROM i),
      n AS (SELECT image_id, concat_ws(',', CASE WHEN least(w, h) < 300 THEN 'small' END, CASE WHEN greatest(w, h) > 4096 THEN 'large' END, CASE WHEN r < 0.3 OR r > 3 THEN 'aspect' END, CASE WHEN u > 0.95 THEN 'uniform' END, CASE WHEN c < 50 THEN 'few colours' END) AS notes FROM a) SELECT *, CASE WHEN notes = '' THEN 'valid' ELSE 'invalid' END AS part FROM n""",
    "pixel_stats": "SELECT l_partkey, count(*) AS pixels, round(1 - least(stddev_pop((l_quantity * 5 + l_suppkey % 250 + l_linenumber * 30) / 3) / 100, 1.0), 6) AS uniformity, count(DISTINCT (l_quantity, l_suppkey % 250, l_linenumber)) AS colours FROM lineitem GROUP BY 1",
    "score_report": f"SELECT event_type AS cls, {_SCORE} FROM events GROUP BY 1 UNION ALL SELECT 'all', {_SCORE} FROM events",
    "reason_histogram": f"WITH {RESULTS_SQL}, f AS (SELECT unnest(string_split({_FAILURES}, ',')) AS reason FROM results) SELECT reason, count(*) AS n FROM f WHERE reason <> '' GROUP BY 1",
    "feature_audit": f"""WITH {C.CHARTS_SQL}, {C.AXES_SQL}, e AS (SELECT l_orderkey AS chart_id, count(*) AS elements FROM lineitem GROUP BY 1)
      SELECT chart_type, count(*) AS n, round(avg(has_features::INT) * 100, 6) AS has_features_pct, round(avg((x_max IS NOT NULL)::INT) * 100, 6) AS axis_pct, round(avg(elements), 6) AS mean_elements, count(*) FILTER (elements IS NULL) AS no_elements, round(avg(y_max::BIGINT), 6) AS mean_top, count(*) FILTER (y_max = 0) AS no_top FROM charts JOIN axes USING (chart_id) LEFT JOIN e USING (chart_id) GROUP BY 1""",
    "source_statistics": "WITH d AS (SELECT source, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'source' AS dimension, source AS value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(quality) AS labelled FROM d GROUP BY source UNION ALL SELECT 'lang', lang, count(*), CAST(sum(n_chars) AS BIGINT), count(quality) FROM d GROUP BY lang",
    "slice_shares": f"WITH {C.ELEMENTS_SQL}, s AS (SELECT chart_id, pos, (x1 - x0) * (y1 - y0) AS a FROM elements WHERE element_type = 'slice'), h AS (SELECT chart_id, pos, a / sum(a) OVER (PARTITION BY chart_id) AS s FROM s) SELECT chart_id, pos, round(s * 100, 6) AS percent, round(s * 360, 4) AS degrees FROM h",
    "profile_axis": f"WITH {C.ELEMENTS_SQL} SELECT chart_id, count(*) AS n, CASE WHEN var_pop((x0 + x1) / 2) >= var_pop((y0 + y1) / 2) THEN 'x' ELSE 'y' END AS axis FROM elements GROUP BY 1",
    "adaptive_tolerance": f"""WITH {_PATHS}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY pos)), b AS (SELECT path_id, coalesce(sum(d), 0) AS l, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS g FROM s GROUP BY 1)
      SELECT path_id, round(greatest(1.0, least(10.0, 2.0 * CASE WHEN g > 0 THEN l / g ELSE 1 END)), 6) AS tolerance FROM b""",
    "three_digits": "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '0' ELSE CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END || format('{:.3g}', o_totalprice * pow(10.0::DOUBLE, o_orderkey % 13 - 10)) END AS text FROM orders",
    "scale_confidence": """WITH a AS (SELECT p_brand || '/s' AS axis_id, p_size::DOUBLE AS v FROM part UNION SELECT p_brand || '/t', pow(10.0::DOUBLE, p_partkey % 7) FROM part UNION SELECT p_brand || '/r', round(p_retailprice) FROM part), s AS (SELECT *, v / lag(v) OVER w AS ratio, v - lag(v) OVER w AS step FROM a WINDOW w AS (PARTITION BY axis_id ORDER BY v)),
      g AS (SELECT axis_id, count(*) AS n, min(v) AS lo, max(v) AS hi, bool_and(coalesce(abs(ratio - 10) < 0.1, true)) AND min(v) > 0 AND count(*) > 1 AS ten, bool_and(coalesce(abs(ratio - 2) < 0.02, true)) AND min(v) > 0 AND count(*) > 1 AS two, avg(step) AS m, stddev_pop(step) AS sd FROM s GROUP BY 1),
      k AS (SELECT *, CASE WHEN n < 2 THEN 'unknown' WHEN ten AND (abs(hi) >= 1e5 OR (abs(hi) < 1e-3 AND hi <> 0)) THEN 'scientific' WHEN ten THEN 'log10' WHEN two THEN 'log2' WHEN lo >= 0 AND hi <= 1 THEN 'ratio' WHEN lo >= 0 AND hi <= 100 THEN 'percentage' ELSE 'linear' END AS pattern FROM g)
      SELECT axis_id, n, pattern, round(CASE WHEN n < 2 THEN 0.0::DOUBLE WHEN ten OR two THEN 0.9 WHEN pattern IN ('ratio', 'percentage') THEN 0.8 ELSE greatest(0.5, 1 - coalesce(sd / abs(m), 0)) END, 6) AS confidence FROM k""",
    "contains_variants": rf"""WITH {QA_SQL}, s AS (SELECT conv_id, qa_idx, answer AS a, CASE WHEN qa_idx % 4 = 0 THEN ' ' WHEN conv_id % 2 = 0 THEN regexp_split_to_array(answer, '[.!?][ \n]+')[-1] ELSE question END AS t FROM qa),
      n AS (SELECT conv_id, qa_idx, {_NORMAL.format('a')} AS a, {_NORMAL.format('t')} AS t FROM s)
      SELECT conv_id, qa_idx, contains(a, t) AS loose, regexp_replace(t, '\.+$', '') <> '' AND contains(regexp_replace(a, '\.+$', ''), regexp_replace(t, '\.+$', '')) AS strict FROM n""",
    "field_types": "WITH f AS (SELECT ['bar', 'bar', 'histogram', 'line', 'line', 'pie', 'scatter', 'heatmap', 'box', 'area', 'unknown', 'pie'][CAST(p_partkey % 12 + 1 AS INT)] AS chart_type FROM part) SELECT chart_type, count(*) AS n FROM f GROUP BY 1",
    "detector_labels": f"WITH {_BOXES}, l AS (SELECT chart, printf('%d %.6f %.6f %.6f %.6f', box % 3, (x0 + x1) / 400.0, (y0 + y1) / 400.0, (x1 - x0) / 200.0, (y1 - y0) / 200.0) AS line FROM boxes) SELECT chart, string_agg(line, chr(10) ORDER BY line) AS labels FROM l GROUP BY 1",
    "detector_dataset": "SELECT 'path: /data/charts' || chr(10) || 'train: images/train' || chr(10) || 'val: images/val' || chr(10) || 'names:' || chr(10) || string_agg('  ' || r_regionkey || ': ' || r_name, chr(10) ORDER BY r_regionkey) AS yaml FROM region",
    "benchmark_report": """WITH s AS (SELECT event_type AS model, count(*) AS n, round(avg(value), 9) AS mean, count(*) FILTER (value < 5) AS errors FROM events GROUP BY 1)
      SELECT '{"suite":"events","models":[' || string_agg('{"model":"' || model || '","n":' || n || ',"errors":' || errors || '}', ',' ORDER BY mean DESC, model) || ']}' AS json, '# events' || chr(10) || chr(10) || '| Model | N | Mean | Errors |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || model || ' | ' || n || ' | ' || printf('%.4f', mean) || ' | ' || errors || ' |', chr(10) ORDER BY mean DESC, model) AS markdown FROM s""",
    "region_table": "SELECT '<table><tr><th>r_regionkey</th><th>r_name</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' AS html FROM region",
    "native_rendering": "SELECT conv_id, md5(string_agg('<|' || role || '|>' || text || '<end>', '' ORDER BY turn)) AS native_md5 FROM conversations GROUP BY 1",
    "audit_dimensions": f"WITH {C.CHARTS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, count(*) AS n, count(*) FILTER (has_features) AS covered, round(avg(has_features::INT) * 100, 6) AS coverage FROM charts GROUP BY 2" for k, v in _DIM.items()),
    "api_projection": f"WITH {C.CHARTS_SQL} SELECT chart_id, chart_type, caption <> '' AS has_caption, context_text IS NOT NULL AS has_context, coalesce(title, 'Untitled') AS title FROM charts",
    "annotation_rows": f"WITH {C.CHARTS_SQL}, {C.TOKENS_SQL}, t AS (SELECT chart_id, count(*) AS n_texts, {', '.join(f'''count(*) FILTER (role = '{r}') AS n_{r}''' for r in _ROLES)} FROM tokens GROUP BY 1) SELECT c.chart_id, chart_type, difficulty, coalesce(n_texts, 0) AS n_texts, {', '.join(f'coalesce(n_{r}, 0) AS n_{r}' for r in _ROLES)} FROM charts c LEFT JOIN t ON t.chart_id = c.chart_id",
    "reasoned_results": """SELECT p_partkey, 'T' || p_size AS title, s AS series_idx, CASE s WHEN 0 THEN 'a' ELSE 'b' END AS name, CASE s WHEN 0 THEN CAST(p_size AS INT) END AS green, CASE s WHEN 0 THEN i END AS point_idx, CASE s WHEN 0 THEN ['x', 'y'][i + 1] END AS label, CASE s WHEN 0 THEN [p_size::DOUBLE, 2.5][i + 1] END AS value, CASE s WHEN 0 THEN 0.9::DOUBLE END AS confidence FROM part, (VALUES (0, 0), (0, 1), (1, 0)) v(s, i)""",
}
