"""Queries of the training-sample build."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import contexts as X
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import read

KINDS = ("structural", "extraction", "trend", "comparison", "range", "multi_hop", "counting", "threshold", "interpolation", "layout")


def _featured(spark, sf_dir):
    charts = C.charts(spark, sf_dir)
    with_features = charts.where("has_features").select("chart_id")
    return X.feature_records(with_features, C.tokens(spark, sf_dir), C.elements(spark, sf_dir), C.axes(spark, sf_dir))


def _contexts(spark, sf_dir):
    return X.context_lines(C.charts(spark, sf_dir), _featured(spark, sf_dir))


def _pairs(spark, sf_dir):
    """A line is a pair about its order's chart; some questions and answers are blank, some difficulties unknown."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    kind = C.pick(F.col("l_partkey"), KINDS)
    pairs = line.select(
        F.col("l_orderkey").alias("chart_id"), C.line_place().alias("qa_idx"), C.pick(F.col("l_orderkey"), C.CHART_TYPES).alias("chart_type"), F.when(F.col("l_partkey") % 31 == 0, "  ").otherwise(F.concat(F.lit("What about part "), F.col("l_partkey").cast("string"), F.lit("? "))).alias("question"),
        F.when(F.col("l_partkey") % 37 != 0, F.col("l_quantity").cast("int").cast("string")).alias("answer"), kind.alias("question_type"), F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 5 + 1).cast("int")).alias("difficulty"), F.lit("generated").alias("source"),
    )
    return pairs


def feature_records(spark, sf_dir):
    """Counts and digests of each chart's record."""
    r = _featured(spark, sf_dir)
    return r.select("chart_id", F.size("texts").alias("n_texts"), F.size("elements").alias("n_elements"), F.md5(F.array_join(F.transform("texts", lambda t: F.concat_ws("|", t["text"], t["role"])), ";")).alias("texts_md5"), F.round(F.aggregate("elements", F.lit(0.0), lambda s, e: s + e["cx"] + e["cy"]), 3).alias("centres"), F.aggregate("elements", F.lit(0).cast("long"), lambda s, e: s + e["area"]).alias("area"), F.col("axis.y_max").alias("y_max"))


def context_lines(spark, sf_dir):
    return _contexts(spark, sf_dir).select("chart_id", "context", F.array_join("features_used", ",").alias("features_used"))


def training_samples(spark, sf_dir):
    s = X.training_samples(_pairs(spark, sf_dir), _contexts(spark, sf_dir))
    text = F.array_join(F.transform("conversations", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "\n")
    return s.select("chart_id", "qa_idx", F.md5(text).alias("talk_md5"), "metadata.curriculum_stage", "metadata.difficulty", "metadata.has_stage3", "metadata.has_axis_info", F.size("metadata.features_used").alias("n_features"))


def curriculum_filter(spark, sf_dir):
    s = X.training_samples(_pairs(spark, sf_dir), _contexts(spark, sf_dir), stage=3)
    return s.groupBy("metadata.chart_type", "metadata.question_type").agg(F.count("*").alias("n"))


def sample_checks(spark, sf_dir):
    return X.sample_checks(X.training_samples(_pairs(spark, sf_dir), _contexts(spark, sf_dir)), C.CHART_TYPES)


def dataset_manifest(spark, sf_dir):
    return X.dataset_manifest(X.training_samples(_pairs(spark, sf_dir), _contexts(spark, sf_dir)))


def source_metadata(spark, sf_dir):
    """Parts as items of three datasets, each with extras of its own."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), (F.col("p_size") % 3).alias("size"), F.col("p_type").alias("kind"), (F.col("p_partkey") % 2 == 0).alias("even"), C.pick(F.col("p_partkey"), ("alpha", "beta", "gamma")).alias("dataset"))
    m = X.source_metadata(p, ("brand", "size"), {"alpha": ("kind",), "beta": ("even", "kind")}, "dataset")
    return m.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


QUERIES = {f.__name__: f for f in (feature_records, context_lines, training_samples, curriculum_filter, sample_checks, dataset_manifest, source_metadata)}

_ROLES = [r for r, _ in X.ROLE_TAGS]
_NAMED = "named AS (SELECT chart_id, pos, trim(text) AS text, lower(coalesce(nullif(role, ''), 'unknown')) AS role FROM tokens WHERE trim(text) <> '')"
_BY_ROLE = """firsts AS (SELECT chart_id, role, text, min(pos) AS f FROM named GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY chart_id, role ORDER BY f) AS k FROM firsts),
  by_role AS (SELECT chart_id, role, string_agg(text, ', ' ORDER BY k) FILTER (k <= 12) AS v FROM ranked GROUP BY ALL),
  plain AS (SELECT chart_id, string_agg(text, ', ' ORDER BY pos) FILTER (k <= 10) AS v FROM (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY pos) AS k FROM named WHERE role = 'unknown') GROUP BY 1),
  kinds AS (SELECT chart_id, element_type, count(*) AS n, min(pos) AS f FROM elements GROUP BY ALL), shapes AS (SELECT chart_id, string_agg(element_type || '=' || n, ', ' ORDER BY n DESC, f) AS v FROM kinds GROUP BY 1),
  roles AS (SELECT chart_id, """ + ", ".join(f"max(v) FILTER (role = '{r}') AS r_{r}" for r in _ROLES) + """ FROM by_role GROUP BY 1)"""
_SURE = "{a}_min IS NOT NULL AND {a}_max IS NOT NULL AND {a}_conf >= 0.30"
_BOUNDS = "'{a}=[' || {a}_min || ', ' || {a}_max || '] conf=' || printf('%.2f', {a}_conf)"
_AXIS = {a: (_SURE.format(a=a), _BOUNDS.format(a=a)) for a in "xy"}
CONTEXTS_SQL = f"""{C.CHARTS_SQL}, {C.TOKENS_SQL}, {C.ELEMENTS_SQL}, {C.AXES_SQL}, {_NAMED}, {_BY_ROLE},
  joined AS (SELECT c.*, r.* EXCLUDE (chart_id), p.v AS plain, s.v AS shapes, a.* EXCLUDE (chart_id), (SELECT count(*) FROM tokens t WHERE t.chart_id = c.chart_id) AS n_texts FROM charts c
    LEFT JOIN roles r ON r.chart_id = c.chart_id LEFT JOIN plain p ON p.chart_id = c.chart_id LEFT JOIN shapes s ON s.chart_id = c.chart_id LEFT JOIN axes a ON a.chart_id = c.chart_id),
  contexts AS (SELECT chart_id, concat_ws(chr(10), '[CHART_TYPE]: ' || upper(chart_type), CASE WHEN has_features THEN nullif(concat_ws(chr(10), {", ".join(f"'[{t}]: ' || r_{r}" for r, t in X.ROLE_TAGS)},
      CASE WHEN {" AND ".join(f"r_{r} IS NULL" for r in _ROLES)} THEN '[OCR_TEXT]: ' || plain END, CASE WHEN n_texts = 0 THEN '[OCR_QUALITY]: low' END,
      '[AXIS_INFO]: ' || nullif(concat_ws(' | ', CASE WHEN {_AXIS['x'][0]} THEN {_AXIS['x'][1]} END, CASE WHEN {_AXIS['y'][0]} THEN {_AXIS['y'][1]} END), ''), '[ELEMENTS]: ' || shapes), '')
    ELSE concat_ws(chr(10), CASE WHEN caption <> '' THEN '[CAPTION]: ' || caption[1:200] END, CASE WHEN context_text <> '' THEN '[CONTEXT]: ' || context_text[1:300] END, CASE WHEN caption = '' AND context_text IS NULL THEN '[OCR_QUALITY]: unavailable' END) END) AS context,
    CASE WHEN has_features THEN concat_ws(',', 'stage3', {", ".join(f"CASE WHEN r_{r} IS NOT NULL THEN 'text_{r}' END" for r in _ROLES)}, CASE WHEN {" AND ".join(f"r_{r} IS NULL" for r in _ROLES)} AND plain IS NOT NULL THEN 'ocr_fallback' END,
      CASE WHEN {_AXIS['x'][0]} THEN 'axis_x' END, CASE WHEN {_AXIS['y'][0]} THEN 'axis_y' END, CASE WHEN shapes IS NOT NULL THEN 'elements' END)
    ELSE concat_ws(',', CASE WHEN caption <> '' THEN 'caption' END, CASE WHEN context_text <> '' THEN 'context_text' END) END AS features_used FROM joined)"""
_PAIRS = f"""pairs AS (SELECT l_orderkey AS chart_id, {C.LINE_SQL} AS qa_idx, {list(C.CHART_TYPES)}[CAST(l_orderkey % 8 + 1 AS INT)] AS chart_type, CASE WHEN l_partkey % 31 = 0 THEN '  ' ELSE 'What about part ' || l_partkey || '? ' END AS question,
    CASE WHEN l_partkey % 37 <> 0 THEN CAST(l_quantity AS INT)::VARCHAR END AS answer, {list(KINDS)}[CAST(l_partkey % 10 + 1 AS INT)] AS question_type, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey % 5 + 1 AS INT) END AS difficulty FROM lineitem)"""
_q = lambda s: "'" + s.replace("'", "''") + "'"
_SAMPLES = f"""{CONTEXTS_SQL}, {_PAIRS}, kept AS (SELECT *, CASE WHEN question_type IN {X.FIRST_STAGE} THEN 1 WHEN question_type IN {X.THIRD_STAGE} THEN 3 ELSE 2 END AS stage FROM pairs WHERE trim(question) <> '' AND trim(answer) <> ''),
  samples AS (SELECT k.*, features_used, 'system:' || [{", ".join(_q(X.SYSTEM_PROMPTS[s]) for s in (1, 2, 3))}][stage] || chr(10) || 'user:' || context || chr(10) || chr(10) || '[QUESTION]: ' || trim(question) || chr(10) || 'assistant:' || trim(answer) AS talk,
    contains(',' || features_used || ',', ',stage3,') AS has_stage3, contains(features_used, 'axis') AS has_axis_info FROM kept k JOIN contexts USING (chart_id))"""
ORACLES = {
    "feature_records": f"""WITH {C.CHARTS_SQL}, {C.TOKENS_SQL}, {C.ELEMENTS_SQL}, {C.AXES_SQL}, t AS (SELECT chart_id, count(*) AS n, string_agg(concat_ws('|', text, role), ';' ORDER BY pos) AS v FROM tokens GROUP BY 1),
      e AS (SELECT chart_id, count(*) AS n, sum((x0 + x1) / 2 + (y0 + y1) / 2) AS c, sum((x1 - x0) * (y1 - y0)) AS a FROM elements GROUP BY 1)
      SELECT c.chart_id, CAST(coalesce(t.n, 0) AS INT) AS n_texts, CAST(coalesce(e.n, 0) AS INT) AS n_elements, md5(coalesce(t.v, '')) AS texts_md5, round(coalesce(e.c, 0.0::DOUBLE), 3) AS centres, CAST(coalesce(e.a, 0) AS BIGINT) AS area, y_max
      FROM charts c LEFT JOIN t ON t.chart_id = c.chart_id LEFT JOIN e ON e.chart_id = c.chart_id LEFT JOIN axes x ON x.chart_id = c.chart_id WHERE has_features""",
    "context_lines": f"WITH {CONTEXTS_SQL} SELECT * FROM contexts",
    "training_samples": f"WITH {_SAMPLES} SELECT chart_id, qa_idx, md5(talk) AS talk_md5, stage AS curriculum_stage, coalesce(difficulty, 3) AS difficulty, has_stage3, has_axis_info, CAST(CASE WHEN features_used = '' THEN 0 ELSE len(string_split(features_used, ',')) END AS INT) AS n_features FROM samples",
    "curriculum_filter": f"WITH {_SAMPLES} SELECT chart_type, question_type, count(*) AS n FROM samples WHERE stage = 3 GROUP BY ALL",
    "sample_checks": f"""WITH {_SAMPLES}, f AS (SELECT count(*) AS n, count(DISTINCT chart_type) AS types, count(DISTINCT question_type) AS kinds FROM samples)
      SELECT 'not_empty' AS "check", n > 0 AS ok, n::VARCHAR AS detail FROM f UNION ALL SELECT 'chart_types', types = 8, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT unnest({list(C.CHART_TYPES)}) AS t) WHERE t NOT IN (SELECT chart_type FROM samples)), '') FROM f
      UNION ALL SELECT 'question_types', kinds >= 8, kinds::VARCHAR FROM f UNION ALL SELECT 'structure', true, '0'""",
    "dataset_manifest": f"""WITH {_SAMPLES} SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM samples UNION ALL SELECT 'chart_type', chart_type, count(*) FROM samples GROUP BY chart_type UNION ALL SELECT 'question_type', question_type, count(*) FROM samples GROUP BY question_type
      UNION ALL SELECT 'curriculum_stage', stage::VARCHAR, count(*) FROM samples GROUP BY stage UNION ALL SELECT 'has_stage3', has_stage3::VARCHAR, count(*) FROM samples GROUP BY has_stage3 UNION ALL SELECT 'has_axis_info', has_axis_info::VARCHAR, count(*) FROM samples GROUP BY has_axis_info""",
    "source_metadata": """SELECT p_partkey, concat_ws(',', 'brand=' || nullif(p_brand, 'Brand#11'), CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'even=true' END, CASE WHEN p_partkey % 3 < 2 THEN 'kind=' || p_type END, CASE WHEN p_size % 3 <> 0 THEN 'size=' || p_size % 3 END) AS metadata FROM part""",
}
