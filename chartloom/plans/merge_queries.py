"""Queries of merges and of joins by place, band and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import extraction as X
from chartloom.operators import merges as M
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import POINTS_SQL, read, series_points


def _sides(spark, sf_dir):
    """Points as a mapper and as a reasoner give them: the reasoner skips some charts and points, some labels, and is more or less sure."""
    p = series_points(spark, sf_dir).select("chart_id", F.col("series_idx").alias("series_ord"), F.col("point_idx").alias("point_ord"), F.col("series_name").alias("name"), F.col("label").cast("string").alias("label"), "value", "confidence")
    mapped = p.where("chart_id % 7 <> 1").withColumn("colour", F.when(F.col("series_ord") % 2 == 0, F.concat(F.lit("#00000"), F.col("series_ord").cast("string"))))
    shown = p.where("chart_id % 5 <> 2 AND point_ord < 9").withColumn("colour", F.when(F.col("series_ord") == 1, "#ffffff"))
    reasoned = shown.withColumn("label", F.when(F.col("point_ord") % 3 != 0, F.concat(F.lit("M"), F.col("label"))).otherwise("")).withColumn("value", F.col("value") / 2).withColumn("confidence", F.lit(0.6)).withColumn("name", F.lower("name"))
    cols = ["chart_id", "series_ord", "name", "colour", "point_ord", "label", "value", "confidence"]
    return mapped.select(*cols), reasoned.select(*cols)


def merged_points(spark, sf_dir):
    return M.merged_points(*_sides(spark, sf_dir))


def legend_colours(spark, sf_dir):
    return M.legend_colours(C.tokens(spark, sf_dir), C.elements(spark, sf_dir))


def corrected_texts(spark, sf_dir):
    """Corrections of three kinds, some twice, some without an original."""
    t = C.tokens(spark, sf_dir)
    n = t.where("text LIKE '1O%' OR role = 'legend'").select("chart_id", F.col("pos").alias("ord"), F.when(F.col("pos") % 5 != 0, F.col("text")).alias("original"), F.concat(F.replace("text", F.lit("O"), F.lit("0")), F.lit("/"), (F.col("pos") % 1000).cast("string")).alias("corrected"))
    return M.corrected_texts(t.select("chart_id", "pos", "text"), n)


def _annotated(spark, sf_dir):
    c = C.charts(spark, sf_dir)
    return c.select("chart_id", "title", (F.col("chart_id") % 4).cast("int").alias("n_elements"), F.nullif("caption", F.lit("")).alias("caption"), F.when(F.col("chart_id") % 9 == 0, "human-verified").when(F.col("chart_id") % 9 == 1, "human").alias("annotator"))


def _seen(spark, sf_dir):
    t = C.tokens(spark, sf_dir).groupBy("chart_id").agg(F.min(F.when(F.col("role") == "title", F.col("text"))).alias("title"), F.min("text").alias("caption"))
    e = C.elements(spark, sf_dir).groupBy("chart_id").agg(F.count("*").cast("int").alias("n_elements"))
    return t.join(e, "chart_id")


def filled_annotations(spark, sf_dir):
    return M.filled(_annotated(spark, sf_dir), _seen(spark, sf_dir), "chart_id", ["title", "n_elements", "caption"])


def overwritten_annotations(spark, sf_dir):
    return M.overwritten(_annotated(spark, sf_dir), _seen(spark, sf_dir), "chart_id", ["title", "n_elements", "caption"], "vision")


def vision_merge(spark, sf_dir):
    c = C.charts(spark, sf_dir)
    old = c.select("chart_id", "chart_type", F.struct(F.lit("bar").alias("kind"), F.lit(3).alias("count"), F.lit(2).alias("series")).alias("elements"), F.struct(F.lit("numeric").alias("x_type"), F.lit("log").alias("y_type"), F.lit(9.0).alias("y_max")).alias("axis"))
    key = F.col("chart_id")
    new = c.where("has_features").select("chart_id", F.when(key % 5 != 0, F.struct(F.when(key % 2 == 0, "slice").alias("kind"), F.when(key % 3 != 0, (key % 40).cast("int")).alias("count"), F.lit(None).cast("int").alias("series"))).alias("elements"), F.when(key % 7 != 0, F.struct(F.when(key % 2 == 1, "date").alias("x_type"), F.lit(None).cast("string").alias("y_type"), F.col("total").alias("y_max"))).alias("axis"))
    m = M.vision_merged(old, new, "chart_id")
    return m.select("chart_id", "elements.kind", "elements.count", "elements.series", "axis.x_type", "axis.y_type", "axis.y_max")


def colour_points(spark, sf_dir):
    return M.colour_points(C.elements(spark, sf_dir))


def chart_descriptions(spark, sf_dir):
    labels = C.tokens(spark, sf_dir).groupBy("chart_id").agg(F.min_by("text", F.when(F.col("role") == "x_axis_label", F.col("pos"))).alias("x_label"), F.min_by("text", F.when(F.col("role") == "y_axis_label", F.col("pos"))).alias("y_label"))
    charts = C.charts(spark, sf_dir).select("chart_id", "chart_type", "title").join(labels, "chart_id", "left")
    return M.described(charts, M.colour_points(C.elements(spark, sf_dir).where("chart_id % 3 <> 0")))


def _named_charts(spark, sf_dir):
    labels = C.tokens(spark, sf_dir).groupBy("chart_id").agg(F.min_by("text", F.when(F.col("role") == "x_axis_label", F.col("pos"))).alias("x_label"), F.min_by("text", F.when(F.col("role") == "y_axis_label", F.col("pos"))).alias("y_label"))
    return C.charts(spark, sf_dir).select("chart_id", "chart_type", "title").join(labels, "chart_id", "left")


def brief_descriptions(spark, sf_dir):
    return M.described_briefly(_named_charts(spark, sf_dir), M.colour_points(C.elements(spark, sf_dir).where("chart_id % 3 <> 0")))


def full_descriptions(spark, sf_dir):
    """Charts with trends, ranges and shares of one in two; labels are their data labels."""
    e = C.elements(spark, sf_dir)
    labels = C.tokens(spark, sf_dir).where("role = 'data_label'").select("chart_id", "pos", "text")
    k = F.col("chart_id")
    facts = C.charts(spark, sf_dir).where("chart_id % 2 = 0").select("chart_id", C.pick((k / 2).cast("long"), ("increasing", "decreasing", "stable", "unknown")).alias("trend"), F.when(k % 3 == 0, F.floor("total")).alias("low"), F.floor(F.col("total") * 2).alias("high"), F.when(F.col("chart_type") == "pie", "top").alias("top_text"), (k % 100).alias("top_value"), (k % 5 == 0).alias("even"))
    return M.described_fully(_named_charts(spark, sf_dir), e, labels, facts)


def complexity_traits(spark, sf_dir):
    return M.complexity(C.elements(spark, sf_dir), C.tokens(spark, sf_dir))


def category_points(spark, sf_dir):
    labels = X.loose_ticks(C.tokens(spark, sf_dir), C.WIDTH, C.HEIGHT).where("label IS NOT NULL").select("chart_id", "pixel", "label")
    return M.category_points(C.elements(spark, sf_dir), labels)


def mapped_points(spark, sf_dir):
    """Data points that have a value: a mapped one, or else a looser one."""
    e = C.elements(spark, sf_dir).select("chart_id", "pos", F.when(F.col("r") == 0, F.col("y0").cast("double")).alias("mapped_y"), F.when(F.col("g") == 0, F.col("y1").cast("double")).alias("mapped_value"), F.when(F.col("confidence") > 0.4, F.col("confidence")).alias("sure"))
    return e.where("mapped_y IS NOT NULL OR mapped_value IS NOT NULL").select("chart_id", "pos", F.coalesce("mapped_y", "mapped_value").alias("y"), F.coalesce("sure", F.lit(0.5)).alias("confidence"))


def _layout(spark, sf_dir):
    """An order as a page: elements are its images, tokens its blocks."""
    images = C.elements(spark, sf_dir).select("chart_id", F.col("pos").alias("image"), F.col("y1").alias("bottom"), F.col("y0").alias("image_top"))
    kind = F.col("pos") % 4
    text = F.when(kind == 0, F.concat(F.lit("Figure "), (F.col("pos") % 100).cast("string"), F.lit(": "), F.col("text"))).when(kind == 1, F.concat(F.lit("see fig. "), F.col("text"))).otherwise(F.col("text"))
    blocks = C.tokens(spark, sf_dir).select("chart_id", F.col("pos").alias("block"), F.col("y0").alias("top"), F.col("y1").alias("block_bottom"), text.alias("text"))
    return images, blocks


def captions_below(spark, sf_dir):
    images, blocks = _layout(spark, sf_dir)
    return M.captions_below(images, blocks, ["chart_id"])


def context_above(spark, sf_dir):
    images, blocks = _layout(spark, sf_dir)
    return M.context_above(images, blocks, ["chart_id"], most=30)


def first_containing(spark, sf_dir):
    """Orders' files against customers' paper keys: a file's stem holds its customer's number, padded, and a neighbour's."""
    key = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 7, "0"))
    papers = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(key(F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("ord"))
    files = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("arxiv_"), key(F.col("o_custkey")), F.lit("_"), key(F.col("o_custkey") + 1), F.lit("v2")).alias("stem"))
    return M.first_containing(files, papers, "o_orderkey", "stem", "key")


def best_error_rates(spark, sf_dir):
    t = C.tokens(spark, sf_dir)
    return M.best_error_rates(t.where("chart_id % 4 <> 0 AND role IS NOT NULL"), t.select("chart_id", "pos", F.replace("text", F.lit("O"), F.lit("0")).alias("text")), "chart_id")


def found_by_role(spark, sf_dir):
    t = C.tokens(spark, sf_dir)
    return M.found_by_role(t.select("chart_id", "pos", "role", F.replace("text", F.lit("1"), F.lit("7")).alias("text")), t.where("pos % 3 <> 0"), "chart_id")


def role_groups(spark, sf_dir):
    return C.tokens(spark, sf_dir).groupBy(M.role_group(F.col("role")).alias("role_group")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


def free_places(spark, sf_dir):
    """Elements of a chart as placed boxes; its tokens' corners as tries."""
    placed = C.elements(spark, sf_dir).select("chart_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    tries = C.tokens(spark, sf_dir).select("chart_id", F.col("pos").alias("ord"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(120).alias("w"), F.lit(90).alias("h"))
    return M.free_places(placed, tries, "chart_id", 10)


def target_values(spark, sf_dir):
    points = C.elements(spark, sf_dir).select("chart_id", "pos", F.when(F.col("r") > 0, F.col("x0")).alias("x"), F.col("y0").alias("y"))
    v = M.target_values(C.charts(spark, sf_dir), points, C.tokens(spark, sf_dir).where("lower(role) IN ('x_tick', 'y_tick')"))
    return v.groupBy("chart_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "|")).alias("values_md5"))


def canonical_context(spark, sf_dir):
    return M.canonical_context(C.charts(spark, sf_dir).where("has_features"), C.tokens(spark, sf_dir), C.elements(spark, sf_dir))


def hex_colours(spark, sf_dir):
    """Hexadecimal colours of suppliers, and back."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", M.hex_colour(*((F.col("s_suppkey") * k % 256).cast("int") for k in (7, 11, 13))).alias("hex"))
    return s.select("s_suppkey", "hex", M.rgb_of(F.col("hex")).alias("c")).select("s_suppkey", "hex", "c.*")


def page_charts(spark, sf_dir):
    """Pages with their charts as arrays, flattened with parent and ordinal: customers and their orders."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("charts"))
    return o.select(F.col("o_custkey").alias("page"), F.posexplode("charts").alias("n", "chart")).select("page", "n", "chart", F.concat_ws("_", F.lit("p"), F.col("page").cast("string"), F.col("n").cast("string")).alias("chart_id"))


QUERIES = {f.__name__: f for f in (merged_points, legend_colours, corrected_texts, filled_annotations, overwritten_annotations, vision_merge, colour_points, chart_descriptions, brief_descriptions, full_descriptions, complexity_traits, category_points, mapped_points, captions_below, context_above, first_containing, best_error_rates, found_by_role, role_groups, free_places, target_values, canonical_context, hex_colours, page_charts)}

_T, _E = C.TOKENS_SQL, C.ELEMENTS_SQL
_HEX = "printf('#%02x%02x%02x', r, g, b)"
_SIDES = f"""{POINTS_SQL}, pts AS (SELECT chart_id, series_idx AS series_ord, point_idx AS point_ord, series_name AS name, label::VARCHAR AS label, value, confidence FROM points),
  mapped AS (SELECT *, CASE WHEN series_ord % 2 = 0 THEN '#00000' || series_ord END AS colour FROM pts WHERE chart_id % 7 <> 1),
  reasoned AS (SELECT chart_id, series_ord, point_ord, lower(name) AS name, CASE WHEN point_ord % 3 <> 0 THEN 'M' || label ELSE '' END AS label, value / 2 AS value, 0.6::DOUBLE AS confidence, CASE WHEN series_ord = 1 THEN '#ffffff' END AS colour FROM pts WHERE chart_id % 5 <> 2 AND point_ord < 9)"""
_ANNOTATED = f"{C.CHARTS_SQL}, {_T}, {_E}, annotated AS (SELECT chart_id, title, CAST(chart_id % 4 AS INT) AS n_elements, nullif(caption, '') AS caption, CASE chart_id % 9 WHEN 0 THEN 'human-verified' WHEN 1 THEN 'human' END AS annotator FROM charts), seen AS (SELECT t.chart_id, title, caption, n_elements FROM (SELECT chart_id, min(text) FILTER (role = 'title') AS title, min(text) AS caption FROM tokens GROUP BY 1) t JOIN (SELECT chart_id, CAST(count(*) AS INT) AS n_elements FROM elements GROUP BY 1) e ON e.chart_id = t.chart_id)"
_OPEN = "s.chart_id IS NOT NULL AND coalesce(a.annotator, '') <> 'human-verified'"
_LAYOUT = f"""WITH {_T}, {_E}, images AS (SELECT chart_id, pos AS image, y1 AS bottom, y0 AS image_top FROM elements), blocks AS (SELECT chart_id, pos AS block, y0 AS top, y1 AS block_bottom, CASE pos % 4 WHEN 0 THEN 'Figure ' || pos % 100 || ': ' || text WHEN 1 THEN 'see fig. ' || text ELSE text END AS text FROM tokens)"""
_FUZZY = """CASE WHEN t = '' OR p = '' THEN false ELSE contains(t, p) OR contains(p, t) OR (tk <> '' AND pk <> '' AND (contains(tk, pk) OR contains(pk, tk))) OR (length(tk) >= 3 AND len(list_filter(string_split(tk, ''), lambda c: contains(pk, c)))::DOUBLE / length(tk) >= 0.6) END"""
_COLOURS = f"coloured AS (SELECT chart_id, pos, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, (y0 + y1) / 2 AS value FROM elements), firsts AS (SELECT *, min(pos) OVER (PARTITION BY chart_id, r, g, b) AS f FROM coloured), colour_points AS (SELECT chart_id, 'Series ' || dense_rank() OVER (PARTITION BY chart_id ORDER BY f) AS series, {_HEX} AS colour, 'Point ' || row_number() OVER (PARTITION BY chart_id, f ORDER BY pos, value) AS label, value, 0.5::DOUBLE AS confidence FROM firsts)"
_NAMED = f"""{C.CHARTS_SQL}, {_T}, {_E}, named AS (SELECT c.chart_id, chart_type, title, total, x_label, y_label FROM charts c LEFT JOIN (SELECT chart_id, arg_min(text, pos) FILTER (role = 'x_axis_label') AS x_label, arg_min(text, pos) FILTER (role = 'y_axis_label') AS y_label FROM tokens GROUP BY 1) t USING (chart_id))"""
ORACLES = {
    "brief_descriptions": f"""WITH {_NAMED}, p AS (SELECT chart_id, count(*) AS n FROM elements WHERE chart_id % 3 <> 0 GROUP BY 1)
      SELECT chart_id, concat_ws('. ', 'A ' || chart_type || ' chart' || CASE WHEN coalesce(title, '') <> '' THEN ' titled "' || title || '"' ELSE '' END, 'with ' || n || ' data points', CASE WHEN x_label <> '' THEN 'x-axis: ' || x_label END, CASE WHEN y_label <> '' THEN 'y-axis: ' || y_label END) || '.' AS description FROM named LEFT JOIN p USING (chart_id)""",
    "full_descriptions": f"""WITH {_NAMED}, p AS (SELECT chart_id, count(*) AS n FROM elements GROUP BY 1), l AS (SELECT chart_id, count(*) AS k, array_to_string(list(text ORDER BY pos)[1:5], ', ') AS shown FROM tokens WHERE role = 'data_label' GROUP BY 1)
      SELECT chart_id, concat_ws(' ', 'This is a ' || CASE chart_type WHEN 'scatter' THEN 'scatter plot' WHEN 'histogram' THEN 'histogram' WHEN 'heatmap' THEN 'heatmap' WHEN 'box' THEN 'box plot' ELSE chart_type || ' chart' END || CASE WHEN coalesce(title, '') <> '' THEN ' titled ' || chr(39) || title || chr(39) || '.' ELSE '.' END,
        'The ' || nullif(concat_ws(' and ', CASE WHEN x_label <> '' THEN 'x-axis represents ' || chr(39) || x_label || chr(39) END, CASE WHEN y_label <> '' THEN 'y-axis represents ' || chr(39) || y_label || chr(39) END), '') || '.',
        CASE WHEN n > 0 THEN CASE chart_type WHEN 'bar' THEN 'The chart contains ' || n || ' bars.' WHEN 'line' THEN 'The chart shows data points connected by lines.' WHEN 'pie' THEN 'The chart has ' || n || ' segments.' WHEN 'scatter' THEN 'The chart displays ' || n || ' data points.' WHEN 'histogram' THEN 'The histogram shows ' || n || ' bins.' WHEN 'box' THEN 'The plot shows ' || n || ' box-and-whisker elements.' END END,
        CASE WHEN chart_id % 2 = 0 THEN CASE chart_id // 2 % 4 WHEN 0 THEN 'The data shows an increasing trend.' WHEN 1 THEN 'The data shows a decreasing trend.' WHEN 2 THEN 'The data shows a stable trend.' END END,
        CASE WHEN chart_id % 6 = 0 THEN 'Values range from ' || CAST(floor(total) AS BIGINT) || ' to ' || CAST(floor(total * 2) AS BIGINT) || '.' END, CASE WHEN chart_id % 2 = 0 AND chart_type = 'pie' THEN 'The largest segment is top (' || chart_id % 100 || '%).' END,
        CASE WHEN chart_id % 10 = 0 THEN 'The segments are relatively evenly distributed.' END, CASE WHEN k <= 5 THEN 'Visible labels include: ' || shown || '.' WHEN k > 5 THEN 'The chart contains ' || k || ' labeled data points.' END) AS description
      FROM named LEFT JOIN p USING (chart_id) LEFT JOIN l USING (chart_id)""",
    "merged_points": f"""WITH {_SIDES}, sc AS (SELECT chart_id, series_ord, min(colour) AS c FROM mapped GROUP BY ALL)
      SELECT r.chart_id, r.series_ord, r.name, coalesce(r.colour, sc.c) AS colour, r.point_ord, CASE WHEN m.confidence > r.confidence AND r.label = '' THEN m.label ELSE r.label END AS label, CASE WHEN m.confidence > r.confidence THEN m.value ELSE r.value END AS value, CASE WHEN m.confidence > r.confidence THEN m.confidence ELSE r.confidence END AS confidence
      FROM reasoned r LEFT JOIN mapped m USING (chart_id, series_ord, point_ord) LEFT JOIN sc ON sc.chart_id = r.chart_id AND sc.series_ord = r.series_ord UNION ALL SELECT chart_id, series_ord, name, colour, point_ord, label, value, confidence FROM mapped WHERE chart_id NOT IN (SELECT chart_id FROM reasoned)""",
    "legend_colours": f"WITH {_T}, {_E}, l AS (SELECT chart_id, text AS label, row_number() OVER (PARTITION BY chart_id ORDER BY pos) - 1 AS place FROM tokens WHERE role = 'legend'), f AS (SELECT chart_id, r, g, b, min(pos) AS pos FROM elements WHERE r IS NOT NULL GROUP BY ALL), c AS (SELECT chart_id, {_HEX} AS hex, row_number() OVER (PARTITION BY chart_id ORDER BY pos) - 1 AS place FROM f) SELECT l.chart_id, CAST(l.place AS INT) AS place, label, hex FROM l LEFT JOIN c ON c.chart_id = l.chart_id AND c.place = l.place",
    "corrected_texts": f"""WITH {_T}, n AS (SELECT chart_id, text AS original, arg_max(replace(text, 'O', '0') || '/' || pos % 1000, pos) AS corrected FROM tokens WHERE (text LIKE '1O%' OR role = 'legend') AND pos % 5 <> 0 GROUP BY ALL) SELECT t.chart_id, pos, coalesce(corrected, text) AS text, corrected IS NOT NULL AS changed FROM tokens t LEFT JOIN n ON n.chart_id = t.chart_id AND original = text""",
    "filled_annotations": f"WITH {_ANNOTATED} SELECT a.chart_id, " + ", ".join(f"CASE WHEN {_OPEN} AND (a.{c} IS NULL OR a.{c}::VARCHAR IN ('', '0')) THEN s.{c} ELSE a.{c} END AS {c}" for c in ("title", "n_elements", "caption")) + f", CASE WHEN {_OPEN} THEN 'auto-prefilled' ELSE a.annotator END AS annotator FROM annotated a LEFT JOIN seen s ON s.chart_id = a.chart_id",
    "overwritten_annotations": f"WITH {_ANNOTATED} SELECT a.chart_id, " + ", ".join(f"CASE WHEN coalesce(s.{c}::VARCHAR, '') <> '' THEN s.{c} ELSE a.{c} END AS {c}" for c in ("title", "n_elements", "caption")) + ", CASE WHEN s.chart_id IS NOT NULL THEN 'vision' ELSE a.annotator END AS annotator FROM annotated a LEFT JOIN seen s ON s.chart_id = a.chart_id",
    "vision_merge": f"""WITH {C.CHARTS_SQL}, f AS (SELECT *, has_features AND chart_id % 5 <> 0 AS e, has_features AND chart_id % 7 <> 0 AS a FROM charts)
      SELECT chart_id, CASE WHEN e AND chart_id % 2 = 0 THEN 'slice' ELSE 'bar' END AS kind, CAST(CASE WHEN NOT e THEN 3 WHEN chart_id % 3 <> 0 THEN chart_id % 40 ELSE 0 END AS INT) AS count, CASE WHEN e THEN 1 ELSE 2 END AS series, CASE WHEN NOT a THEN 'numeric' WHEN chart_type = 'pie' THEN NULL WHEN chart_id % 2 = 1 THEN 'date' ELSE 'categorical' END AS x_type,
        CASE WHEN NOT a THEN 'log' WHEN chart_type <> 'pie' THEN 'linear' END AS y_type, CASE WHEN NOT a THEN 9.0::DOUBLE WHEN chart_type <> 'pie' THEN total END AS y_max FROM f""",
    "colour_points": f"WITH {_E}, {_COLOURS} SELECT * FROM colour_points",
    "chart_descriptions": f"""WITH {C.CHARTS_SQL}, {_T}, {_E}, {_COLOURS}, l AS (SELECT chart_id, arg_min(text, pos) FILTER (role = 'x_axis_label') AS x, arg_min(text, pos) FILTER (role = 'y_axis_label') AS y FROM tokens GROUP BY 1), n AS (SELECT chart_id, count(*) AS n, count(DISTINCT series) AS s FROM colour_points WHERE chart_id % 3 <> 0 GROUP BY 1)
      SELECT c.chart_id, concat_ws('. ', 'This ' || chart_type || ' chart' || coalesce(' titled "' || title || '"', ''), 'contains ' || n || ' data points across ' || s || ' series', 'with ' || nullif(concat_ws(' and ', 'x-axis showing ' || x, 'y-axis showing ' || y), '')) || '.' AS description FROM charts c LEFT JOIN l ON l.chart_id = c.chart_id LEFT JOIN n ON n.chart_id = c.chart_id""",
    "complexity_traits": f"WITH {_T}, {_E}, e AS (SELECT chart_id, count(*) > 20 AS dense, count(DISTINCT CASE WHEN r IS NOT NULL THEN (r, g, b) END) > 2 AS multi_series, count(*) AS elements FROM elements GROUP BY 1), t AS (SELECT chart_id, bool_or(coalesce(role = 'legend', false)) AS legend, bool_or(coalesce(role = 'data_label', false)) AS data_labels FROM tokens GROUP BY 1) SELECT e.*, coalesce(legend, false) AS legend, coalesce(data_labels, false) AS data_labels FROM e LEFT JOIN t USING (chart_id)",
    "category_points": f"""WITH {_T}, {_E}, v AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, trim(text) AS t FROM tokens), l AS (SELECT chart_id, cx AS px, t AS label FROM v WHERE cy >= {C.HEIGHT * 0.75} AND cx >= {C.WIDTH * 0.1} AND length(t) BETWEEN 1 AND 29 AND NOT regexp_matches(t, '^[+-]?[0-9,]+(\\.[0-9]*)?%?$')),
      j AS (SELECT e.chart_id, e.pos, label, abs((x0 + x1) / 2 - px) AS gap, row_number() OVER (PARTITION BY e.chart_id, e.pos ORDER BY abs((x0 + x1) / 2 - px), px, label) AS k FROM elements e JOIN l ON l.chart_id = e.chart_id) SELECT chart_id, pos, label, CASE WHEN gap < 50 THEN 0.9::DOUBLE ELSE 0.6 END AS confidence FROM j WHERE k = 1""",
    "mapped_points": f"WITH {_E} SELECT chart_id, pos, CASE WHEN r = 0 THEN y0 ELSE y1 END::DOUBLE AS y, CASE WHEN confidence > 0.4 THEN confidence ELSE 0.5::DOUBLE END AS confidence FROM elements WHERE r = 0 OR g = 0",
    "captions_below": rf"""{_LAYOUT}, j AS (SELECT i.chart_id, image, block, text, regexp_matches(text, '(?i)(figure\s+\d+[.:]\s*.+|fig\.\s*\d+[.:]\s*.+|chart\s+\d+[.:]\s*.+)') AS named FROM images i JOIN blocks b ON b.chart_id = i.chart_id AND top BETWEEN bottom AND bottom + 100), a AS (SELECT chart_id, image, coalesce(arg_min(text, block) FILTER (named), arg_min(text[1:500], block)) AS caption FROM j GROUP BY ALL) SELECT i.chart_id, i.image, caption FROM images i LEFT JOIN a ON a.chart_id = i.chart_id AND a.image = i.image""",
    "context_above": f"{_LAYOUT} SELECT i.chart_id, image, string_agg(text, ' ' ORDER BY block)[1:30] AS context FROM images i JOIN blocks b ON b.chart_id = i.chart_id AND block_bottom BETWEEN image_top - 200 AND image_top GROUP BY ALL",
    "first_containing": "SELECT o_orderkey, (SELECT min('p' || lpad(c_custkey::VARCHAR, 7, '0')) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey IN (o_custkey, o_custkey + 1)) AS paper FROM orders",
    "best_error_rates": f"""WITH {_T}, p AS (SELECT DISTINCT chart_id, lower(trim(text)) AS p FROM tokens WHERE chart_id % 4 <> 0 AND role IS NOT NULL AND trim(text) <> ''), t AS (SELECT chart_id, pos, lower(trim(replace(text, 'O', '0'))) AS t FROM tokens WHERE trim(text) <> '') SELECT t.chart_id, pos, coalesce(round(min(levenshtein(p, t)::DOUBLE / length(t)), 6), 1.0) AS cer FROM t LEFT JOIN p ON p.chart_id = t.chart_id GROUP BY ALL""",
    "found_by_role": f"""WITH {_T}, p AS (SELECT DISTINCT chart_id, lower(trim(text)) AS p FROM tokens WHERE pos % 3 <> 0), t AS (SELECT chart_id, pos, coalesce(role, 'unknown') AS role, lower(trim(replace(text, '1', '7'))) AS t FROM tokens), k AS (SELECT t.*, p, regexp_replace(t, '[^a-z0-9]', '', 'g') AS tk, regexp_replace(p, '[^a-z0-9]', '', 'g') AS pk FROM t LEFT JOIN p ON p.chart_id = t.chart_id),
      f AS (SELECT chart_id, pos, role, bool_or(coalesce({_FUZZY}, false)) AS found FROM k GROUP BY ALL) SELECT role, count(*) AS n, count(*) FILTER (found) AS found FROM f GROUP BY 1""",
    "role_groups": f"WITH {_T}, g AS (SELECT text, coalesce(role, 'other') AS r FROM tokens) SELECT CASE WHEN contains(r, 'tick') THEN 'tick_label' WHEN contains(r, 'axis_label') THEN 'axis_label' WHEN r = 'legend' THEN 'legend' WHEN contains(r, 'data_label') THEN 'data_label' WHEN r = 'title' THEN 'title' ELSE 'other' END AS role_group, count(*) AS n, count(DISTINCT text) AS texts FROM g GROUP BY 1",
    "free_places": f"""WITH {_T}, {_E}, j AS (SELECT t.chart_id, t.pos AS ord, t.x0 AS x, t.y0 AS y, bool_and(t.x0 + 130 < e.x0 OR t.x0 > e.x1 + 10 OR t.y0 + 100 < e.y0 OR t.y0 > e.y1 + 10) AS free FROM tokens t JOIN elements e ON e.chart_id = t.chart_id GROUP BY ALL) SELECT chart_id, min(ord) AS tried, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM j WHERE free GROUP BY 1""",
    "target_values": f"""WITH {C.CHARTS_SQL}, {_T}, {_E}, v AS (SELECT chart_id, 0 AS part, 0 AS a, 0 AS b, title AS value FROM charts WHERE title <> '' UNION ALL SELECT chart_id, 1, pos, 0, x0::VARCHAR FROM elements WHERE r > 0 UNION ALL SELECT chart_id, 1, pos, 1, y0::VARCHAR FROM elements UNION ALL SELECT chart_id, 2, pos, 0, text FROM tokens WHERE lower(role) IN ('x_tick', 'y_tick'))
      SELECT chart_id, count(*) AS n, md5(string_agg(value, '|' ORDER BY part, a, b)) AS values_md5 FROM v GROUP BY 1""",
    "canonical_context": f"""WITH {C.CHARTS_SQL}, {_T}, {_E}, t AS (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY pos) AS n FROM tokens), tj AS (SELECT chart_id, string_agg('{{"text":"' || text || '","role":"' || coalesce(role, 'unknown') || '"}}', ',' ORDER BY n) AS j FROM t WHERE n <= 5 AND confidence >= 0.5 GROUP BY 1),
      e AS (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY pos) AS n FROM elements), ej AS (SELECT chart_id, string_agg('{{"type":"' || element_type || '","x2":' || (x0 + x1) || coalesce(',"color":"RGB(' || r || ',' || g || ',' || b || ')"', '') || '}}', ',' ORDER BY n) AS j FROM e WHERE n <= 4 GROUP BY 1)
      SELECT c.chart_id, '{{"chart_id":' || c.chart_id || ',"chart_type":"' || chart_type || '"' || coalesce(',"texts":[' || tj.j || ']', '') || coalesce(',"elements":[' || ej.j || ']', '') || '}}' AS payload FROM charts c LEFT JOIN tj ON tj.chart_id = c.chart_id LEFT JOIN ej ON ej.chart_id = c.chart_id WHERE has_features""",
    "hex_colours": f"WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 256 AS INT) AS r, CAST(s_suppkey * 11 % 256 AS INT) AS g, CAST(s_suppkey * 13 % 256 AS INT) AS b FROM supplier) SELECT s_suppkey, {_HEX} AS hex, r, g, b FROM s",
    "page_charts": "SELECT o_custkey AS page, CAST(row_number() OVER w - 1 AS INT) AS n, o_orderkey AS chart, concat_ws('_', 'p', o_custkey, row_number() OVER w - 1) AS chart_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
}
