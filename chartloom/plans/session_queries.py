"""Queries over sessions, runs, logs, retries and calibrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators import calibrate as K
from chartloom.operators import insights as I
from chartloom.operators import sessions as S
from chartloom.plans.corpus_queries import _PATHS, _paths
from chartloom.plans.dataset_queries import _PAIRS as _TICK_PAIRS
from chartloom.plans.dataset_queries import _TICKS, _ticks
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import POINTS_SQL, read, series_points


def _charts(points):
    """A supplier is a session, its years are charts; some have no title, some no description."""
    key = F.col("chart_id")
    return points.select("chart_id").distinct().select(
        "chart_id", F.floor(key / 10000).alias("session_id"), C.pick(key, ("bar", "line", "pie")).alias("chart_type"), F.when(key % 4 != 0, F.concat(F.lit("Year "), (key % 10000).cast("string"))).alias("chart_title"),
        F.when(key % 5 != 0, "some text").alias("description"), F.lit("month").alias("x_axis_label"), F.lit(None).cast("string").alias("y_axis_label"),
    )


def _odd_points(spark, sf_dir):
    """Points of which some are not finite, some series empty and some charts without any."""
    p = series_points(spark, sf_dir)
    value = F.when((F.col("chart_id") + F.col("point_idx")) % 11 == 0, F.lit(float("nan"))).when((F.col("chart_id") + F.col("series_idx")) % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return p.withColumn("value", value)


def chart_warnings(spark, sf_dir):
    p = _odd_points(spark, sf_dir)
    series = p.where("chart_id % 17 <> 3").select("chart_id", "series_idx", "series_name").distinct()
    return S.chart_warnings(_charts(p).select("chart_id", "description"), series, p.where("(chart_id + series_idx) % 7 <> 5"))


def session_summary(spark, sf_dir):
    p = series_points(spark, sf_dir)
    return S.session_summary(_charts(p), p, I.top_insights(p))


def summary_insights(spark, sf_dir):
    return S.summary_insights(series_points(spark, sf_dir))


def flat_rows(spark, sf_dir):
    p = series_points(spark, sf_dir)
    rows = p.select("chart_id", "series_name", F.col("label").cast("string").alias("label"), F.format_string("%.2f", "value").alias("value"), F.lit(None).cast("string").alias("unit"), F.format_string("%.4f", "confidence").alias("confidence"))
    return S.flat_rows(_charts(p), rows)


def text_reports(spark, sf_dir):
    p = series_points(spark, sf_dir)
    return S.text_report(_charts(p), p, 2).select("chart_id", F.md5("report").alias("report_md5"))


def document_reports(spark, sf_dir):
    p = series_points(spark, sf_dir)
    w = S.chart_warnings(_charts(p).select("chart_id", "description"), p.select("chart_id", "series_idx", "series_name").distinct(), p)
    return S.document_report(_charts(p), p, w, 3).select("session_id", F.length("report").alias("chars"), F.md5("report").alias("report_md5"))


def provenance(spark, sf_dir):
    """Elements as detections with where they come from, as JSON."""
    e = C.elements(spark, sf_dir).where("element_type = 'bar'").select(F.col("pos").alias("chart_id"), F.concat(F.lit("order"), F.col("chart_id").cast("string"), F.lit(".pdf")).alias("source_file"), F.lit(1).alias("page"), (F.col("pos") % 7).alias("place"), "x0", "y0", "x1", "y1", F.lit(0.5).alias("detection"), F.lit(0.25).alias("extraction"))
    return S.provenance(e).select("chart_id", F.to_json("provenance").alias("provenance"))


def flat_runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.create_map(F.lit("loss"), F.format_string("%.2f", "o_totalprice"), F.lit("status"), F.col("o_orderstatus"), F.lit("steps"), F.col("o_custkey").cast("string")).alias("metrics"))
    return S.flat_runs(o).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def last_runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started"))
    return S.last_runs(o, ["started", "run_id"], 20, "F").select("run_id", "status")


def latest_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prefix"), F.concat_ws("_", "o_orderpriority", F.date_format("o_orderdate", "yyyyMM")).alias("run_name"), F.col("o_orderstatus").alias("model"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("score"))
    return S.latest_metrics(o, ["score"])


def trainer_states(spark, sf_dir):
    """Customers as runs, their orders as log rows: every third an evaluation, some with both losses."""
    key = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), key.alias("step"), F.when(key % 3 != 0, F.col("o_totalprice")).alias("loss"), F.when(key % 3 != 1, F.col("o_totalprice") / 2).alias("eval_loss"))
    return S.trainer_states(o)


def resumed_batch(spark, sf_dir):
    return S.resumable(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id", 50)


def retried(spark, sf_dir):
    a = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("request_id"), (F.col("event_id") % 4 + 1).cast("int").alias("k"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") == "error").alias("auth_error"))
    return S.retried(a)


def provider_health(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), "ts", F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 4 == 0, "auth").otherwise("down")).otherwise("ok").alias("result"))
    return S.health(e).groupBy("provider").agg(F.count_if("cached").alias("cached"), F.count_if("healthy").alias("healthy"))


def batch_progress(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("ord"), F.col("value").alias("seconds"), F.col("event_type").alias("status"))
    return S.progress(e, 80)


def status_counts(spark, sf_dir):
    """Progress by status, and how many have what was asked for."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("success")
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 25).alias("with_axis"))


def synthetic_charts(spark, sf_dir):
    return S.synthetic_charts(spark, 60)


def date_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 30 + 1990).cast("int")).alias("y"), F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 12 + 1).cast("int")).alias("m"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") % 28 + 1).cast("int")).alias("d"))
    day = S.date_parts(F.col("y"), F.col("m"), F.col("d"))
    stamp = F.concat(day, F.lit("T08:30:00"), F.when(F.col("p_partkey") % 2 == 0, "Z").otherwise("+02:00"))
    return p.select("p_partkey", day.alias("day"), F.unix_seconds(S.iso_instant(stamp)).alias("instant"))


def hashes(spark, sf_dir):
    """Ids out of contents: MD5 cut to 8, 12 and 16, and SHA-256."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", *(F.left(F.md5("t"), F.lit(k)).alias(f"md5_{k}") for k in (8, 12, 16)), F.sha2("t", 256).alias("sha256"))


def markdown_titles(spark, sf_dir):
    """A Markdown document's first heading, else its file's name in title case; and its local pictures."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n# Report "), F.col("doc_id").cast("string"), F.lit("  \n# Other\n"))).otherwise(""), F.lit("![a](one.png) ![b](https://far/two.png)")).alias("text"), F.concat(F.lit("/in/my_report-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return d.select("doc_id", T.markdown_title(F.col("text"), F.col("path")).alias("title"))


def context_texts(spark, sf_dir):
    """Texts cleaned of control characters and doubled blanks, cut at 800."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\n]", "").alias("text"))
    return d.select("doc_id", F.md5(T.truncated(T.cleaned(F.col("text")))).alias("text_md5"))


def keyword_pages(spark, sf_dir):
    """Pages whose title or text holds one of a few words, in any case; and listings' links, PDFs and authors apart."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("links"))
    return p.where(F.lower("title").rlike("the|que|der")).select("page_id", "title", "links")


def listing_papers(spark, sf_dir):
    """Papers out of a listing's HTML: title, page, PDF and authors of each entry."""
    s = read(spark, sf_dir, "supplier")
    entry = F.concat(F.lit('<p class="d-sm-flex"><a href="/P'), F.col("s_suppkey").cast("string"), F.lit('.pdf">pdf</a><strong><a href="/P'), F.col("s_suppkey").cast("string"), F.lit('/">On '), F.col("s_name"), F.lit('</a></strong><a href="/people/a">Ann</a> <a href="/people/b">Ben</a></p>'))
    pages = s.groupBy(F.floor(F.col("s_suppkey") / 5).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("html"))
    return T.papers(pages, "page", "html")


def pending_files(spark, sf_dir):
    """Files large enough that no result has yet, uncertain ones left out."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    left = d.where("bytes >= 200 AND source <> 'src3'").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def value_recall(spark, sf_dir):
    """How much of each order's values its linear table holds: all, numbers within a twentieth, and texts; 1 of nothing."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", "l_partkey")
    t = line.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity"))).alias("numbers"), F.collect_set(F.when(F.col("l_partkey") % 2 != 0, F.lower("l_returnflag"))).alias("texts"))
    v = line.where("l_linenumber <> 4").join(t, "l_orderkey").select("l_orderkey", F.exists("numbers", lambda n: F.abs(n - F.col("l_quantity")) / F.col("l_quantity") <= 0.05).alias("n_hit"), F.array_contains("texts", F.lower("l_returnflag")).alias("t_hit"), (F.col("l_partkey") % 4 == 0).alias("is_text"))
    num, txt = ~F.col("is_text"), F.col("is_text")
    share = lambda hit, of: F.round(F.coalesce(F.try_divide(F.count_if(hit & of), F.count_if(of)), F.lit(1.0)), 4)
    return v.groupBy("l_orderkey").agg(F.round(F.count_if((num & F.col("n_hit")) | (txt & F.col("t_hit"))) / F.count("*"), 4).alias("recall"), share(F.col("n_hit"), num).alias("numeric_recall"), share(F.col("t_hit"), txt).alias("text_recall"), F.count("*").alias("total"))


def theil_sen_inliers(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    return S.theil_sen_inliers(t, K.theil_sen(t))


def ransac_refit(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    return S.refitted(t, K.ransac_pairs(t, tolerance=5000.0), "axis_id", 5000.0)


def axis_steps(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * F.when(F.col("p_brand").endswith("1"), 1.0).otherwise(2.5)).alias("v"))
    return S.step_facts(p, "p_brand", "v")


def lying_bars(spark, sf_dir):
    return S.lying_bars(C.elements(spark, sf_dir))


def path_corners(spark, sf_dir):
    return S.corners(_paths(spark, sf_dir), "path_id")


QUERIES = {
    f.__name__: f
    for f in (
        chart_warnings, session_summary, summary_insights, flat_rows, text_reports, document_reports, provenance, flat_runs, last_runs, latest_metrics, trainer_states, resumed_batch, retried, provider_health, batch_progress, status_counts,
        synthetic_charts, date_parts, hashes, markdown_titles, context_texts, keyword_pages, listing_papers, pending_files, value_recall, theil_sen_inliers, ransac_refit, axis_steps, lying_bars, path_corners,
    )
}

_CHARTS = f"""{POINTS_SQL}, charts AS (SELECT DISTINCT chart_id, chart_id // 10000 AS session_id, ['bar', 'line', 'pie'][CAST(chart_id % 3 + 1 AS INT)] AS chart_type, CASE WHEN chart_id % 4 <> 0 THEN 'Year ' || chart_id % 10000 END AS chart_title, CASE WHEN chart_id % 5 <> 0 THEN 'some text' END AS description FROM points)"""
_INSIGHTS = """tr AS (SELECT chart_id, count(*) AS n FROM (SELECT chart_id, series_idx FROM points GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1), co AS (SELECT chart_id, count(DISTINCT series_idx) > 1 AS c, max(value) AS m FROM points GROUP BY 1),
  an AS (SELECT chart_id, count(*) AS n FROM (SELECT *, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(*) OVER w AS k FROM points WINDOW w AS (PARTITION BY chart_id, series_idx)) WHERE k >= 4 AND z > 2 GROUP BY 1),
  ins AS (SELECT co.chart_id, least(5, 1 + coalesce(tr.n, 0) + c::INT + coalesce(an.n, 0)) AS n FROM co LEFT JOIN tr USING (chart_id) LEFT JOIN an USING (chart_id))"""
_TS = f"{_TICKS}, {_TICK_PAIRS}, s AS (SELECT axis_id, median(m) AS slope FROM pairs GROUP BY 1), f AS (SELECT axis_id, round(any_value(slope), 6) AS slope, round(median(value - slope * pixel), 6) AS intercept FROM ticks JOIN s USING (axis_id) GROUP BY 1)"
_RANSAC = f"""{_TICKS}, {_TICK_PAIRS}, c AS (SELECT l.axis_id, p, q, v, m, count(*) FILTER (abs(t.value - (v + m * (t.pixel - p))) < 5000.0) AS inliers FROM pairs l JOIN ticks t ON l.axis_id = t.axis_id GROUP BY ALL),
  l AS (SELECT axis_id, round(m, 6) AS m, round(v - m * p, 4) AS b FROM (SELECT *, row_number() OVER (PARTITION BY axis_id ORDER BY inliers DESC, p, q) AS r FROM c) WHERE r = 1)"""
_DRAW = lambda *c: f"(('0x' || substr(md5('42:' || {' || chr(58) || '.join(c)}), 1, 6))::INT::DOUBLE / 16777216)"
ORACLES = {
    "chart_warnings": f"""WITH {_CHARTS}, p AS (SELECT * REPLACE (CASE WHEN (chart_id + point_idx) % 11 = 0 THEN 'nan'::DOUBLE WHEN (chart_id + series_idx) % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS value) FROM points),
      s AS (SELECT DISTINCT chart_id, series_idx, series_name FROM points WHERE chart_id % 17 <> 3), b AS (SELECT chart_id, series_idx, count(*) AS n, min(point_idx) FILTER (isnan(value) OR isinf(value)) AS odd, count(*) FILTER (confidence < 0.5) AS low FROM p WHERE (chart_id + series_idx) % 7 <> 5 GROUP BY ALL),
      w AS (SELECT chart_id, -2 AS o, 0 AS k, 'no description' AS warning FROM charts WHERE description IS NULL UNION ALL SELECT chart_id, -1, 0, 'no data series' FROM charts WHERE chart_id % 17 = 3 UNION ALL SELECT s.chart_id, s.series_idx, 0, 'empty series ' || series_name FROM s LEFT JOIN b USING (chart_id, series_idx) WHERE n IS NULL
        UNION ALL SELECT s.chart_id, s.series_idx, 0, 'non-finite value in ' || series_name || ' at ' || odd FROM s JOIN b USING (chart_id, series_idx) WHERE odd IS NOT NULL UNION ALL SELECT s.chart_id, s.series_idx, 1, 'low confidence in ' || series_name || ': ' || low || '/' || n FROM s JOIN b USING (chart_id, series_idx) WHERE low > 0)
      SELECT chart_id, CAST(row_number() OVER (PARTITION BY chart_id ORDER BY o, k) - 1 AS INT) AS place, warning FROM w""",
    "session_summary": f"""WITH {_CHARTS}, {_INSIGHTS}, t AS (SELECT session_id, chart_type, count(*) AS n FROM charts GROUP BY ALL), l AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS charts, string_agg(n || ' ' || chart_type, ', ' ORDER BY chart_type) AS types FROM t GROUP BY 1)
      SELECT l.*, (SELECT count(*) FROM points p WHERE p.chart_id // 10000 = l.session_id) AS points, CAST((SELECT sum(n) FROM ins i WHERE i.chart_id // 10000 = l.session_id) AS BIGINT) AS insights FROM l""",
    "summary_insights": f"WITH {POINTS_SQL}, s AS (SELECT chart_id, series_idx, series_name, count(*) AS n FROM points GROUP BY ALL) SELECT chart_id, 'Chart contains ' || sum(n)::BIGINT || ' data points across ' || count(*) || ' series (' || string_agg(series_name, ', ' ORDER BY series_idx) FILTER (series_idx < 3) || ')' AS text FROM s GROUP BY 1",
    "flat_rows": f"WITH {_CHARTS} SELECT session_id::VARCHAR AS session_id, chart_id::VARCHAR AS chart_id, chart_type, coalesce(chart_title, '') AS chart_title, series_name, label::VARCHAR AS label, printf('%.2f', value) AS value, '' AS unit, printf('%.4f', confidence) AS confidence, 'month' AS x_axis_label, '' AS y_axis_label FROM points JOIN charts USING (chart_id)",
    "text_reports": f"""WITH {_CHARTS}, s AS (SELECT chart_id, series_idx, '  ' || series_name || ' (' || count(*) || ' points): ' || string_agg(label || '=' || printf('%.2f', value), ', ' ORDER BY point_idx) FILTER (point_idx < 2) || CASE WHEN count(*) > 2 THEN ' ...' ELSE '' END AS line FROM points GROUP BY chart_id, series_idx, series_name)
      SELECT chart_id, md5('Chart ' || chart_id || ' [' || any_value(chart_type) || '] ' || coalesce(any_value(chart_title), 'Untitled') || chr(10) || string_agg(line, chr(10) ORDER BY series_idx)) AS report_md5 FROM s JOIN charts USING (chart_id) GROUP BY chart_id""",
    "document_reports": f"""WITH {_CHARTS}, s AS (SELECT chart_id, series_idx, '### ' || series_name || chr(10) || '| Label | Value |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || label || ' | ' || printf('%.2f', value) || ' |', chr(10) ORDER BY point_idx) FILTER (point_idx < 3) AS t FROM points GROUP BY chart_id, series_idx, series_name),
      b AS (SELECT chart_id, string_agg(t, chr(10) ORDER BY series_idx) AS tables FROM s GROUP BY 1), lw AS (SELECT chart_id, series_idx, series_name, count(*) FILTER (confidence < 0.5) AS low, count(*) AS n FROM points GROUP BY ALL),
      w AS (SELECT chart_id, -1 AS o, '- no description' AS warning FROM charts WHERE description IS NULL UNION ALL SELECT chart_id, series_idx, '- low confidence in ' || series_name || ': ' || low || '/' || n FROM lw WHERE low > 0), wa AS (SELECT chart_id, string_agg(warning, chr(10) ORDER BY o) AS warned FROM w GROUP BY 1),
      k AS (SELECT session_id, c.chart_id, concat_ws(chr(10), '## ' || coalesce(chart_title, 'Chart ' || c.chart_id), tables, '**Warnings**' || chr(10) || warned) AS block FROM charts c JOIN b USING (chart_id) LEFT JOIN wa USING (chart_id)), t AS (SELECT session_id, chart_type, count(*) AS n FROM charts GROUP BY ALL),
      r AS (SELECT session_id, '# Session ' || session_id || chr(10) || 'Charts: ' || (SELECT count(*) FROM charts c WHERE c.session_id = k.session_id) || chr(10) || '| Type | Charts |' || chr(10) || '|---|---|' || chr(10) || (SELECT string_agg('| ' || chart_type || ' | ' || n || ' |', chr(10) ORDER BY chart_type) FROM t WHERE t.session_id = k.session_id) || chr(10) || string_agg(block, chr(10) ORDER BY chart_id) AS report FROM k GROUP BY session_id)
      SELECT session_id, CAST(length(report) AS INT) AS chars, md5(report) AS report_md5 FROM r""",
    "provenance": f"""WITH {C.ELEMENTS_SQL} SELECT pos AS chart_id, '{{"source_file":"order' || chart_id || '.pdf","page":1,"place":' || pos % 7 || ',"box":{{"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '}},"confidence":{{"detection":0.5,"extraction":0.25}}}}' AS provenance FROM elements WHERE element_type = 'bar'""",
    "flat_runs": "SELECT 'agg_loss' AS name, count(*) AS n, round(sum(round(o_totalprice, 2)), 2) AS total FROM orders UNION ALL SELECT 'agg_steps', count(*), round(sum(o_custkey)::DOUBLE, 2) FROM orders",
    "last_runs": "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "latest_metrics": "WITH o AS (SELECT o_orderpriority AS prefix, o_orderpriority || '_' || strftime(o_orderdate, '%Y%m') AS run_name, o_orderstatus AS model, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::DOUBLE END AS score FROM orders), l AS (SELECT prefix, max(run_name) AS run_name FROM o GROUP BY 1) SELECT prefix, run_name, model, round(coalesce(avg(score), 0), 6) AS score FROM o JOIN l USING (prefix, run_name) GROUP BY ALL",
    "trainer_states": "SELECT o_custkey AS run_id, max(o_orderkey) AS step, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 = 1) AS loss, arg_max(o_totalprice / 2, o_orderkey) FILTER (o_orderkey % 3 <> 1) AS eval_loss, min(o_totalprice / 2) FILTER (o_orderkey % 3 <> 1) AS best FROM orders GROUP BY 1",
    "resumed_batch": "SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // 50 AS checkpoint FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "retried": """WITH a AS (SELECT event_id // 4 AS request_id, event_id % 4 + 1 AS k, event_type = 'purchase' AS ok, event_type = 'error' AS auth FROM events WHERE event_id % 4 < 3), m AS (SELECT *, coalesce(max((ok OR auth)::INT) OVER (PARTITION BY request_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM a)
      SELECT request_id, count(*) AS made, CASE WHEN bool_or(ok) THEN 'succeeded' WHEN bool_or(auth) THEN 'aborted' ELSE 'exhausted' END AS outcome, CAST(pow(2, count(*) - 1) - 1 AS BIGINT) AS waited FROM m WHERE over = 0 GROUP BY 1""",
    "provider_health": """WITH e AS (SELECT user_id AS provider, event_type <> 'error' AS ok, coalesce(max((event_type = 'error' AND event_id % 4 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS cached FROM events) SELECT provider, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached AND ok) AS healthy FROM e GROUP BY 1""",
    "batch_progress": "WITH p AS (SELECT user_id AS worker, event_id AS ord, count(*) OVER w AS done, CAST(sum((event_type = 'error')::INT) OVER w AS BIGINT) AS errors, round(avg(value) OVER w, 9) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT *, round(greatest(0, 80 - done) * mean, 5) AS eta FROM p",
    "status_counts": "SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status, count(*) AS n, count(*) FILTER (value > 25) AS with_axis FROM events GROUP BY 1",
    "synthetic_charts": f"""WITH c AS (SELECT id AS chart_id, ['bar', 'line', 'pie'][CAST(id % 3 + 1 AS INT)] AS chart_type, ['uniform', 'increasing', 'decreasing', 'wave'][CAST(floor({_DRAW("id", "'p'")} * 4) + 1 AS INT)] AS pattern, floor({_DRAW("id", "'f'")} * 3) AS family FROM range(60) t(id)), p AS (SELECT *, {_DRAW("chart_id", "k")} AS noise FROM c, range(6) r(k))
      SELECT chart_id, chart_type, pattern, CAST(k AS INT) AS point_idx, CASE family WHEN 0 THEN 'M' || (k % 12 + 1) WHEN 1 THEN 'Q' || (k % 4 + 1) ELSE chr(CAST(65 + k AS INT)) END AS label,
        round(CASE pattern WHEN 'uniform' THEN 10 + noise * 90 ELSE 20 + CASE pattern WHEN 'increasing' THEN k * 10.0::DOUBLE WHEN 'decreasing' THEN (5 - k) * 10.0::DOUBLE ELSE 40 + CASE k % 4 WHEN 1 THEN 30.0::DOUBLE WHEN 3 THEN -30.0 ELSE 0 END END + noise * 5 END, 4) AS value FROM p""",
    "date_parts": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 30 + 1990 END AS y, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 12 + 1 ELSE 1 END AS m, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 28 + 1 ELSE 1 END AS d FROM part), t AS (SELECT p_partkey, printf('%d-%02d-%02d', y, m, d) AS day, y, m, d FROM p)
      SELECT p_partkey, CASE WHEN y IS NOT NULL THEN day END AS day, CASE WHEN y IS NOT NULL THEN CAST(epoch(make_timestamp(y::BIGINT, m::BIGINT, d::BIGINT, 8, 30, 0.0)) AS BIGINT) - CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 7200 END END AS instant FROM t""",
    "hashes": "SELECT doc_id, left(md5(coalesce(text, '')), 8) AS md5_8, left(md5(coalesce(text, '')), 12) AS md5_12, left(md5(coalesce(text, '')), 16) AS md5_16, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "markdown_titles": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Report ' || doc_id ELSE 'My Report ' || doc_id END AS title FROM documents",
    "context_texts": r"WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g'), '\s+', ' ', 'g') AS t FROM documents), s AS (SELECT doc_id, trim(t) AS t FROM t) SELECT doc_id, md5(CASE WHEN length(t) > 800 THEN t[1:800] || '...' ELSE t END) AS text_md5 FROM s",
    "keyword_pages": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS links FROM pages WHERE regexp_matches(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'the|que|der')""",
    "listing_papers": "SELECT s_suppkey // 5 AS page, CAST(row_number() OVER (PARTITION BY s_suppkey // 5 ORDER BY s_suppkey::VARCHAR) - 1 AS INT) AS n, 'On ' || s_name AS title, '/P' || s_suppkey || '/' AS link, '/P' || s_suppkey || '.pdf' AS pdf, 'Ann, Ben' AS authors FROM supplier",
    "pending_files": "SELECT source, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents WHERE strlen(coalesce(text, '')) >= 200 AND source <> 'src3' AND doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "value_recall": """WITH v AS (SELECT l.l_orderkey, l_partkey % 4 = 0 AS txt, EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_partkey % 3 <> 0 AND abs(m.l_quantity - l.l_quantity) / l.l_quantity <= 0.05) AS nh, EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_partkey % 2 <> 0 AND m.l_returnflag = l.l_returnflag) AS th FROM lineitem l WHERE l_linenumber <> 4)
      SELECT l_orderkey, round(count(*) FILTER ((NOT txt AND nh) OR (txt AND th))::DOUBLE / count(*), 4) AS recall, round(coalesce(count(*) FILTER (NOT txt AND nh)::DOUBLE / nullif(count(*) FILTER (NOT txt), 0), 1), 4) AS numeric_recall, round(coalesce(count(*) FILTER (txt AND th)::DOUBLE / nullif(count(*) FILTER (txt), 0), 1), 4) AS text_recall, count(*) AS total FROM v GROUP BY 1""",
    "theil_sen_inliers": f"WITH {_TS}, d AS (SELECT axis_id, value - (intercept + slope * pixel) AS d FROM ticks JOIN f USING (axis_id)), e AS (SELECT *, stddev_pop(d) OVER (PARTITION BY axis_id) AS sd FROM d) SELECT axis_id, count(*) AS n, count(*) FILTER (sd <= 1e-9 OR abs(d) <= 2 * sd) AS inliers, round(sqrt(avg(d * d) FILTER (sd <= 1e-9 OR abs(d) <= 2 * sd)), 4) AS rms FROM e GROUP BY 1",
    "ransac_refit": f"WITH {_RANSAC}, j AS (SELECT axis_id, pixel, value, abs(value - (b + m * pixel)) < 5000.0 AS i FROM ticks JOIN l USING (axis_id)) SELECT axis_id, count(*) FILTER (i) AS inliers, round(regr_slope(value, pixel) FILTER (i), 6) AS slope, round(regr_intercept(value, pixel) FILTER (i), 4) AS intercept, round(count(*) FILTER (i)::DOUBLE / count(*) * regr_r2(value, pixel) FILTER (i), 6) AS confidence FROM j GROUP BY 1 HAVING count(*) FILTER (i) >= 2",
    "axis_steps": """WITH v AS (SELECT DISTINCT p_brand, p_size * CASE WHEN p_brand LIKE '%1' THEN 1.0::DOUBLE ELSE 2.5 END AS v FROM part), s AS (SELECT *, v - lag(v) OVER w AS step, v / lag(v) OVER w AS ratio FROM v WINDOW w AS (PARTITION BY p_brand ORDER BY v))
      SELECT p_brand, count(*) AS n, round(avg(step), 6) AS mean_step, coalesce(max(step) - min(step) <= 0.01 * abs(avg(step)), false) AS even_steps, coalesce(max(ratio) - min(ratio) <= 0.01 * abs(avg(ratio)), false) AS even_ratios, bool_and(abs(v - round(v)) < 0.01) AS whole FROM s GROUP BY 1""",
    "lying_bars": f"WITH {C.ELEMENTS_SQL} SELECT chart_id, count(*) AS bars, stddev_pop((y0 + y1) / 2) > 2 * stddev_pop((x0 + x1) / 2) AS horizontal, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM elements WHERE element_type = 'bar' GROUP BY 1",
    "path_corners": f"""WITH {_PATHS}, s AS (SELECT path_id, pos, lag(x, 2) OVER w - x AS ax, lag(y, 2) OVER w - y AS ay, lead(x, 2) OVER w - x AS bx, lead(y, 2) OVER w - y AS b_y FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
      a AS (SELECT path_id, pos, round(abs(degrees(atan2(ay * bx - ax * b_y, -(ax * bx + ay * b_y)))), 4) AS angle FROM s WHERE ax IS NOT NULL AND bx IS NOT NULL) SELECT * FROM a WHERE angle >= 45""",
}
