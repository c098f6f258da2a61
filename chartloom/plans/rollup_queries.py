"""Queries of chart evaluation and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T
from chartloom.operators import rollup as R
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import QA_SQL, qa_pairs, read


def _results(spark, sf_dir):
    charts = C.charts(spark, sf_dir)
    gt_type = F.when(F.col("chart_type").isin("bar", "histogram", "box"), "bar").when(F.col("chart_type").isin("line", "area"), "line").when(F.col("chart_type") == "pie", "slice").otherwise("point")
    gt_count = F.when(F.col("chart_id") % 3 == 0, F.concat(F.lit("~"), (F.col("chart_id") % 4).cast("string"))).otherwise((F.col("chart_id") % 4).cast("string"))
    axis = C.axes(spark, sf_dir).select("chart_id", F.struct(*R.BOUNDS).alias("axis"))
    annotations = charts.select("chart_id", "chart_type", "difficulty", gt_type.alias("gt_type"), gt_count.alias("gt_count")).join(axis, "chart_id")
    types = C.elements(spark, sf_dir).groupBy("chart_id").agg(F.array_sort(F.collect_list("element_type")).alias("types"))
    off = F.when(F.col("chart_id") % 3 == 0, 1.1).when(F.col("chart_id") % 3 == 1, 1.5).otherwise(1.0)
    found = C.axes(spark, sf_dir).select("chart_id", F.struct("x_min", F.when(F.col("chart_id") % 4 != 0, F.col("x_max")).alias("x_max"), F.lit(0.5).alias("y_min"), (F.col("y_max") * off).alias("y_max")).alias("axis"))
    return R.chart_results(annotations, C.predicted(spark, sf_dir).join(types, "chart_id", "left").join(found, "chart_id"))


def chart_results(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("chart_id", "pred_type", "error", "classified", "e.gt_count", "e.pred_count", "e.pred_total", R.r6(F.col("e.error")).alias("count_error"), F.col("e.within").alias("count_within"), "e.type_correct", F.col("a.total").alias("axis_total"), F.col("a.within").alias("axis_within"), F.col("a.known").alias("axis_known"), R.r6(F.col("a.errors")).alias("axis_errors"))


def result_rollup(spark, sf_dir):
    return R.result_rollup(_results(spark, sf_dir))


def error_confusion(spark, sf_dir):
    return R.error_confusion(_results(spark, sf_dir))


def audit_rows(spark, sf_dir):
    return R.audit_rows(_results(spark, sf_dir)).select("chart_id", "chart_type", F.array_join("failures", ",").alias("failures"))


def type_summary(spark, sf_dir):
    return R.type_summary(_results(spark, sf_dir))


def classifier_report(spark, sf_dir):
    c = C.charts(spark, sf_dir).select("chart_id", "chart_type").join(C.predicted(spark, sf_dir).select("chart_id", "pred_type"), "chart_id")
    return R.classifier_report(c, "chart_type", "pred_type", (*C.CHART_TYPES, "donut"))


def misclassified(spark, sf_dir):
    c = C.charts(spark, sf_dir).select("chart_id", "chart_type", "difficulty").join(C.predicted(spark, sf_dir).select("chart_id", "pred_type"), "chart_id")
    return c.where("pred_type <> chart_type")


def pair_metrics_by(spark, sf_dir):
    fold = lambda c: F.regexp_replace(c, r"[^ -~]", "")
    p = qa_pairs(spark, sf_dir).withColumn("a", fold(F.col("answer"))).withColumn("q", fold(F.col("question")))
    rows = p.select("question_type", "difficulty", T.exact_match(F.col("a"), F.col("q")).alias("exact"), T.contains_match(F.col("a"), F.col("q")).alias("contains"), N.number_recall(F.col("a"), F.col("q")).alias("numeric"), F.round(T.bleu_1(F.col("a"), F.col("q")), 6).alias("bleu"), (F.length("a") / 100).alias("seconds"))
    return R.pair_metrics_by(rows, ["question_type", "difficulty"])


def _models(spark, sf_dir):
    """Event types as models, their events as scored samples."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    part = lambda k: F.least(F.lit(1.0), F.pmod(F.col("event_id") * k, F.lit(97)).cast("double") / 96)
    return e.select(F.col("event_type").alias("model"), part(7).alias("exact"), part(11).alias("contains"), F.when(F.col("event_type") != "view", part(13)).alias("numeric"), part(17).alias("bleu"), "event_id")


def model_ranking(spark, sf_dir):
    means = _models(spark, sf_dir).groupBy("model").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("exact", "contains", "numeric", "bleu")), F.min("event_id").alias("ord"))
    return R.ranked_models(means)


def suite_means(spark, sf_dir):
    return R.suite_means(_models(spark, sf_dir), ["exact", "contains", "bleu"])


def pairwise_winners(spark, sf_dir):
    means = read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return R.pairwise_winners(means, "event_type", "mean", 0.05)


def run_summaries(spark, sf_dir):
    """Users as runs, their events as stages that end a few seconds after they start."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    s = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("stage"), (F.col("event_type") != "error").alias("ok"), start.alias("started"), (start + F.col("event_id") % 977 * 1000).alias("ended"))
    return R.run_summaries(s)


def human_sizes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 7 + 1)).alias("n"))
    return d.select("doc_id", R.human_size(F.col("n")).alias("size"))


def confidence_labels(spark, sf_dir):
    """Mean confidence of each chart's elements with its label, and the weighted confidence of its parts."""
    by = C.elements(spark, sf_dir).groupBy("chart_id").agg(F.avg("confidence").alias("c"), F.countDistinct("r", "g", "b").alias("colours"))
    p = C.predicted(spark, sf_dir).select("chart_id", "overall", F.least("seconds", F.lit(1.0)).alias("s"))
    both = by.join(p, "chart_id").withColumn("c", F.round("c", 6))
    return both.select("chart_id", "colours", "c", R.quality_label(F.col("c")).alias("label"), R.r6(R.overall_confidence(F.col("c"), F.col("overall"), F.col("s"), F.lit(0.5))).alias("weighted"))


def image_sizes(spark, sf_dir):
    return R.size_profile(read(spark, sf_dir, "part").select((F.col("p_partkey") % 1500 + 50).alias("width"), (F.col("p_size") * 30 + 20).alias("height")))


def class_routing(spark, sf_dir):
    return R.routed(C.charts(spark, sf_dir).select("chart_id", "chart_type").join(C.predicted(spark, sf_dir).select("chart_id", "overall"), "chart_id"), "chart_type", "overall", 0.4)


def qa_per_image(spark, sf_dir):
    """Mean pairs a chart, and what 500 looked-at ones say of false positives in all."""
    by = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("odd"))
    return by.agg(F.count("*").alias("images"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_pairs"), F.expr("sum(odd) * count(*) div 500").alias("false_positives"))


def images_per_paper(spark, sf_dir):
    """Paper ids out of chart ids of two forms, and images a paper."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    chart = F.concat(F.lit("arxiv_"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_page_").otherwise("_p"), F.col("o_orderkey").cast("string"), F.lit("_img_1"))
    chart = F.when(F.col("o_orderkey") % 10 == 9, F.concat(F.lit("loose"), F.col("o_custkey").cast("string"))).otherwise(chart)
    by = o.select(chart.alias("chart")).select(T.paper_id(F.col("chart")).alias("paper"), T.safe_id(F.col("chart")).alias("safe")).groupBy("paper").agg(F.count("*").alias("images"), F.min("safe").alias("first"))
    return by


QUERIES = {f.__name__: f for f in (chart_results, result_rollup, error_confusion, audit_rows, type_summary, classifier_report, misclassified, pair_metrics_by, model_ranking, suite_means, pairwise_winners, run_summaries, human_sizes, confidence_labels, image_sizes, class_routing, qa_per_image, images_per_paper)}

_FOLD = lambda c: f"CASE {c} WHEN 'stacked_bar' THEN 'bar' WHEN 'grouped_bar' THEN 'bar' WHEN 'donut' THEN 'pie' ELSE {c} END"
_BOUND = lambda b, p: f"CASE WHEN g.{b} IS NULL OR {p} IS NULL THEN NULL WHEN abs(g.{b}) < 1e-10 THEN CASE WHEN abs({p}) > 1e-10 THEN abs({p}) ELSE 0.0 END ELSE abs({p} - g.{b}) / abs(g.{b}) END"
_PRED = {"x_min": "g.x_min", "x_max": "CASE WHEN c.chart_id % 4 <> 0 THEN g.x_max END", "y_min": "0.5::DOUBLE", "y_max": "g.y_max * CASE c.chart_id % 3 WHEN 0 THEN 1.1::DOUBLE WHEN 1 THEN 1.5 ELSE 1.0 END"}
RESULTS_SQL = f"""{C.CHARTS_SQL}, {C.ELEMENTS_SQL}, {C.AXES_SQL}, {C.PREDICTED_SQL},
  types AS (SELECT chart_id, count(*) AS n, count(*) FILTER (element_type = 'bar') AS bar, count(*) FILTER (element_type = 'point') AS point, count(*) FILTER (element_type = 'slice') AS slice FROM elements GROUP BY 1),
  raw AS (SELECT c.chart_id, c.chart_type, difficulty, coalesce(p.pred_type, 'unknown') AS pred_type, CASE WHEN p.chart_id IS NULL THEN 'missing_image_or_annotation' WHEN failed THEN 'failed' END AS error, {_FOLD('c.chart_type')} = {_FOLD("coalesce(p.pred_type, 'unknown')")} AS classified,
    CAST(c.chart_id % 4 AS INT) AS gt_count, CASE WHEN p.chart_id IS NULL THEN 0 ELSE CAST(coalesce(CASE WHEN c.chart_type IN ('bar', 'histogram', 'box') THEN bar WHEN c.chart_type IN ('line', 'area') THEN point WHEN c.chart_type = 'pie' THEN slice ELSE point END, 0) AS INT) END AS pred_count,
    CASE WHEN p.chart_id IS NULL THEN 0 ELSE CAST(coalesce(n, 0) AS INT) END AS pred_total, coalesce(overall, 0.0::DOUBLE) AS overall, coalesce(seconds, 0.0::DOUBLE) AS seconds,
    [{", ".join(f"CASE WHEN g.{b} IS NOT NULL THEN 1 END" for b in R.BOUNDS)}] AS given, [{", ".join(f"CASE WHEN p.chart_id IS NOT NULL THEN {_BOUND(b, _PRED[b])} END" for b in R.BOUNDS)}] AS off
    FROM charts c JOIN axes g ON g.chart_id = c.chart_id LEFT JOIN predicted p ON p.chart_id = c.chart_id LEFT JOIN types t ON t.chart_id = c.chart_id),
  results AS (SELECT *, CASE WHEN gt_count = 0 THEN CASE WHEN pred_count = 0 THEN 0.0::DOUBLE ELSE 1.0 END ELSE abs(pred_count - gt_count)::DOUBLE / gt_count END AS count_error, pred_count > 0 AS type_correct,
    CAST(len(list_filter(given, lambda x: x IS NOT NULL)) AS INT) AS axis_total, CAST(len(list_filter(off, lambda x: x <= 0.15)) AS INT) AS axis_within, CAST(len(list_filter(off, lambda x: x IS NOT NULL)) AS INT) AS axis_known, coalesce(list_sum(off), 0.0::DOUBLE) AS axis_errors FROM raw)"""
_METRICS = {
    "charts": "count(*)::DOUBLE", "errors": "count(*) FILTER (error IS NOT NULL)::DOUBLE", "classification_accuracy": "coalesce(avg(classified::INT) FILTER (error IS NULL), 0)",
    "element_tolerance_accuracy": "coalesce(avg((count_error <= 0.25)::INT) FILTER (error IS NULL AND gt_count > 0), 0)", "element_exact": "count(*) FILTER (error IS NULL AND gt_count > 0 AND gt_count = pred_count)::DOUBLE",
    "element_type_accuracy": "coalesce(avg(type_correct::INT) FILTER (error IS NULL AND gt_count > 0), 0)", "element_mean_error": "coalesce(avg(count_error) FILTER (error IS NULL AND gt_count > 0), 0)",
    "axis_ranges": "coalesce(sum(axis_total) FILTER (error IS NULL), 0)::DOUBLE", "axis_accuracy": "coalesce(sum(axis_within) FILTER (error IS NULL)::DOUBLE / nullif(sum(axis_total) FILTER (error IS NULL), 0), 0)",
    "axis_mean_error": "coalesce(sum(axis_errors) FILTER (error IS NULL) / nullif(sum(axis_known) FILTER (error IS NULL), 0), 0)", "mean_confidence": "coalesce(avg(overall) FILTER (error IS NULL), 0)", "mean_seconds": "coalesce(avg(seconds) FILTER (error IS NULL), 0)",
}
_AGG = ", ".join(f"round({v}, 6) AS {k}" for k, v in _METRICS.items())
_FAILURES = """CASE WHEN error IS NOT NULL THEN 'error: ' || error ELSE concat_ws(',', CASE WHEN NOT classified THEN 'classification' END, CASE WHEN pred_total = 0 THEN 'no_elements' END, CASE WHEN count_error > 0.25 THEN 'element_count' END,
    CASE WHEN axis_within < axis_total THEN 'axis' END, CASE WHEN overall < 0.5 THEN 'low_confidence' END) END"""
_CLS = f"{C.CHARTS_SQL}, {C.PREDICTED_SQL}, m AS (SELECT chart_id, chart_type AS gt, pred_type AS pred, difficulty FROM charts JOIN predicted USING (chart_id))"
_MODELS = "models AS (SELECT event_type AS model, event_id, least(1.0::DOUBLE, (event_id * 7 % 97)::DOUBLE / 96) AS exact, least(1.0::DOUBLE, (event_id * 11 % 97)::DOUBLE / 96) AS contains, CASE WHEN event_type <> 'view' THEN least(1.0::DOUBLE, (event_id * 13 % 97)::DOUBLE / 96) END AS numeric, least(1.0::DOUBLE, (event_id * 17 % 97)::DOUBLE / 96) AS bleu FROM events)"
_SUITE = ("exact", "contains", "bleu")
ORACLES = {
    "chart_results": f"WITH {RESULTS_SQL} SELECT chart_id, pred_type, error, classified, gt_count, pred_count, pred_total, round(count_error, 6) AS count_error, count_error <= 0.25 AS count_within, type_correct, axis_total, axis_within, axis_known, round(axis_errors, 6) AS axis_errors FROM results",
    "result_rollup": f"""WITH {RESULTS_SQL}, w AS (SELECT 'summary' AS section, 'all' AS key, {_AGG} FROM results UNION ALL SELECT 'chart_type', chart_type, {_AGG} FROM results GROUP BY chart_type UNION ALL SELECT 'difficulty', difficulty, {_AGG} FROM results GROUP BY difficulty)
      SELECT section, key, metric, value FROM w UNPIVOT (value FOR metric IN ({", ".join(_METRICS)}))""",
    "error_confusion": f"WITH {RESULTS_SQL} SELECT chart_type || '->' || pred_type AS pair, count(*) AS n FROM results WHERE error IS NULL AND NOT classified GROUP BY 1",
    "audit_rows": f"WITH {RESULTS_SQL} SELECT chart_id, chart_type, {_FAILURES} AS failures FROM results",
    "type_summary": f"""WITH {RESULTS_SQL}, f AS (SELECT chart_type, split_part(unnest(string_split({_FAILURES}, ',')), ':', 1) AS reason FROM results), k AS (SELECT chart_type, reason, count(*) AS k FROM f WHERE reason <> '' GROUP BY ALL), l AS (SELECT chart_type, string_agg(reason || '=' || k, ',' ORDER BY k DESC, reason) AS reasons FROM k GROUP BY 1)
      SELECT r.chart_type, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND classified) AS classified, count(*) FILTER (error IS NULL AND axis_total > 0 AND axis_within = axis_total) AS axes_right, round(avg(overall) FILTER (error IS NULL), 6) AS mean_confidence, any_value(reasons) AS reasons FROM results r LEFT JOIN l ON l.chart_type = r.chart_type GROUP BY r.chart_type""",
    "classifier_report": f"""WITH {_CLS}, k AS (SELECT unnest({[*C.CHART_TYPES, "donut"]}) AS cls), c AS (SELECT cls, (SELECT count(*) FROM m WHERE gt = cls) AS t, (SELECT count(*) FROM m WHERE pred = cls) AS p, (SELECT count(*) FROM m WHERE gt = cls AND pred = cls) AS h FROM k),
      d AS (SELECT *, coalesce(h::DOUBLE / nullif(p, 0), 0) AS precision, coalesce(h::DOUBLE / nullif(t, 0), 0) AS recall FROM c), e AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM d),
      u AS (SELECT cls, t AS support, precision, recall, f1 FROM e UNION ALL SELECT 'macro', sum(t), avg(precision), avg(recall), avg(f1) FROM e UNION ALL SELECT 'macro_seen', sum(t), avg(precision), avg(recall), avg(f1) FROM e WHERE t > 0
        UNION ALL SELECT 'accuracy', sum(t), sum(h)::DOUBLE / sum(t), sum(h)::DOUBLE / sum(t), sum(h)::DOUBLE / sum(t) FROM e)
      SELECT cls, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM u""",
    "misclassified": f"WITH {_CLS} SELECT chart_id, gt AS chart_type, difficulty, pred AS pred_type FROM m WHERE gt <> pred",
    "pair_metrics_by": f"""WITH {QA_SQL}, s AS (SELECT question_type, difficulty, regexp_replace(answer, '[^ -~]', '', 'g') AS a, regexp_replace(question, '[^ -~]', '', 'g') AS q FROM qa),
      n AS (SELECT *, regexp_replace(trim(lower(a)), '\\s+', ' ', 'g') AS p, regexp_replace(trim(lower(q)), '\\s+', ' ', 'g') AS t, regexp_extract_all(lower(a), '-?\\d+(?:\\.\\d+)?(?:e[+-]?\\d+)?') AS na, regexp_extract_all(lower(q), '-?\\d+(?:\\.\\d+)?(?:e[+-]?\\d+)?') AS nq FROM s),
      w AS (SELECT *, list_filter(string_split(regexp_replace(p, '\\.+$', ''), ' '), lambda x: x <> '') AS ta, list_filter(string_split(regexp_replace(t, '\\.+$', ''), ' '), lambda x: x <> '') AS tr FROM n),
      m AS (SELECT question_type, CAST(difficulty AS VARCHAR) AS difficulty, p = t AS exact, contains(p, t) AS contains, length(a)::DOUBLE / 100 AS seconds,
        CASE WHEN len(nq) = 0 THEN -1.0::DOUBLE WHEN len(na) = 0 THEN 0 ELSE len(list_filter(nq, lambda x: len(list_filter(na, lambda y: CASE WHEN abs(x::DOUBLE) < 1e-9 THEN abs(y::DOUBLE) < 1e-9 ELSE abs(y::DOUBLE - x::DOUBLE) / (abs(x::DOUBLE) + 1e-9) <= 0.05 END)) > 0))::DOUBLE / len(nq) END AS numeric,
        round(CASE WHEN len(ta) = 0 OR len(tr) = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN len(ta) < len(tr) THEN exp(1 - len(tr)::DOUBLE / len(ta)) ELSE 1.0 END) * list_sum(list_transform(list_distinct(ta), lambda v: least(len(list_filter(ta, lambda x: x = v)), len(list_filter(tr, lambda x: x = v))))) / len(ta) END, 6) AS bleu FROM w),
      g AS (SELECT 'all' AS dimension, 'all' AS value, * FROM m UNION ALL SELECT 'question_type', question_type, * FROM m UNION ALL SELECT 'difficulty', difficulty, * FROM m)
      SELECT dimension, value, count(*) AS n, round(avg(exact::INT), 6) AS exact, round(avg(contains::INT), 6) AS contains, round(avg(numeric) FILTER (numeric >= 0), 6) AS numeric, round(avg(bleu), 6) AS bleu, round(avg(seconds), 6) AS mean_seconds, round(1 / nullif(avg(seconds), 0), 6) AS per_second FROM g GROUP BY ALL""",
    "model_ranking": f"""WITH {_MODELS}, a AS (SELECT model, round(avg(exact), 6) AS exact, round(avg(contains), 6) AS contains, round(avg(numeric), 6) AS numeric, round(avg(bleu), 6) AS bleu, min(event_id) AS ord FROM models GROUP BY 1),
      b AS (SELECT model, ord, round(exact * 100 * 0.4::DOUBLE + contains * 100 * 0.3::DOUBLE + coalesce(numeric, 0) * 100 * 0.2::DOUBLE + bleu * 100 * 0.1::DOUBLE, 6) AS score FROM a) SELECT model, score, row_number() OVER (ORDER BY score DESC, ord) AS place FROM b""",
    "suite_means": f"WITH {_MODELS}, a AS (SELECT model, {', '.join(f'avg({m}) AS {m}' for m in _SUITE)} FROM models GROUP BY 1) " + " UNION ALL ".join(f"SELECT model || '.{m}' AS name, round({m}, 4) AS mean FROM a" for m in _SUITE) + " UNION ALL SELECT model || '.overall', round((exact + contains + bleu) / 3, 4) FROM a",
    "pairwise_winners": """WITH m AS (SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1) SELECT a.event_type AS one, b.event_type AS other, CASE WHEN abs(a.mean - b.mean) <= 0.05 THEN 'tie' WHEN a.mean > b.mean THEN a.event_type ELSE b.event_type END AS winner, round(abs(a.mean - b.mean), 6) AS margin FROM m a JOIN m b ON a.event_type < b.event_type""",
    "run_summaries": """WITH s AS (SELECT user_id AS run_id, event_id AS ord, event_type || '-' || event_id AS stage, event_type <> 'error' AS ok, event_id % 977 AS ms FROM events),
      a AS (SELECT run_id, bool_and(ok) AS ok, arg_min(stage, ord) FILTER (NOT ok) AS first_failed, CAST(sum(ms) AS BIGINT) AS ms, arg_max(stage, ms * 1000000000 - ord) AS longest, count(*) AS stages FROM s GROUP BY 1)
      SELECT *, CASE WHEN ms >= 3600000 THEN printf('%dh %02dm %02ds', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) WHEN ms >= 60000 THEN printf('%dm %02ds', ms // 60000, ms // 1000 % 60) ELSE printf('%d.%ds', ms // 1000, ms // 100 % 10) END AS took FROM a""",
    "human_sizes": "WITH d AS (SELECT doc_id, n_chars * n_chars * (doc_id % 7 + 1) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' " + " ".join(f"WHEN n < 1024::BIGINT ** {k + 1} THEN printf('%d.%d {u}', CAST(n * 10 // CAST(1024 ** {k} AS BIGINT) AS BIGINT) // 10, CAST(n * 10 // CAST(1024 ** {k} AS BIGINT) AS BIGINT) % 10)" for k, u in ((1, "KB"), (2, "MB"), (3, "GB"))) + " ELSE printf('%d.%d TB', n * 10 // CAST(1024 ** 4 AS BIGINT) // 10, n * 10 // CAST(1024 ** 4 AS BIGINT) % 10) END AS size FROM d",
    "confidence_labels": f"""WITH {C.ELEMENTS_SQL}, {C.PREDICTED_SQL}, e AS (SELECT chart_id, round(avg(confidence), 6) AS c, count(DISTINCT CASE WHEN r IS NOT NULL THEN (r, g, b) END) AS colours FROM elements GROUP BY 1)
      SELECT chart_id, colours, c, CASE WHEN c > 0.9 THEN 'high' WHEN c > 0.7 THEN 'medium' ELSE 'low' END AS label, round(c * 0.3::DOUBLE + overall * 0.25::DOUBLE + least(seconds, 1.0) * 0.25::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE, 6) AS weighted FROM e JOIN predicted USING (chart_id)""",
    "image_sizes": "WITH i AS (SELECT p_partkey % 1500 + 50 AS w, p_size * 30 + 20 AS h FROM part) SELECT count(*) AS n, min(w) AS least_width, max(w) AS most_width, round(avg(w), 6) AS mean_width, min(h) AS least_height, max(h) AS most_height, round(avg(h), 6) AS mean_height, count(*) FILTER (w < 200 OR h < 200) AS small, count(*) FILTER (w BETWEEN 200 AND 1000 AND h BETWEEN 200 AND 1000) AS medium, count(*) FILTER (w > 1000 OR h > 1000) AS large FROM i",
    "class_routing": f"WITH {C.CHARTS_SQL}, {C.PREDICTED_SQL}, r AS (SELECT CASE WHEN overall < 0.4 THEN 'uncertain' ELSE chart_type END AS folder FROM charts JOIN predicted USING (chart_id)) SELECT folder, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS percent FROM r GROUP BY 1",
    "qa_per_image": "WITH b AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS odd FROM lineitem GROUP BY 1) SELECT count(*) AS images, round(sum(n)::DOUBLE / count(*), 6) AS mean_pairs, CAST(sum(odd) * count(*) // 500 AS BIGINT) AS false_positives FROM b",
    "images_per_paper": """WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'loose' || o_custkey ELSE 'arxiv_' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '_page_' ELSE '_p' END || o_orderkey || '_img_1' END AS chart FROM orders)
      SELECT CASE WHEN contains(chart, '_page_') THEN split_part(chart, '_page_', 1) ELSE split_part(chart, '_p', 1) END AS paper, count(*) AS images, min(replace(replace(replace(chart, '/', '_'), ':', '_'), '.', '_')) AS first FROM c GROUP BY 1""",
}
