"""Queries over documents, pages, tables and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T
from chartloom.operators import colours as K
from chartloom.operators import curves as V
from chartloom.operators import geometry as G
from chartloom.operators import grids as D
from chartloom.operators import joins as J
from chartloom.operators import reshape as R
from chartloom.sources.tables import read


def _tables(spark, sf_dir):
    """A linearised table of each order: lines as rows, quantity and discount as columns."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    row = F.format_string("item%d | %.0f | %.0f%%", "l_linenumber", "l_quantity", F.col("l_discount") * 100)
    by = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    text = F.concat(F.lit("TITLE | Order<0x0A>Item | Quantity<0x0A> | Discount<0x0A>"), F.array_join(F.col("rows.r"), R.BREAK))
    return R.parsed(by.select("l_orderkey", text.alias("text")), "text")


def linear_table_parse(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return t.select("l_orderkey", F.array_join("t.headers", ",").alias("headers"), F.size("t.rows").alias("rows"))


def table_unpivot(spark, sf_dir):
    return R.unpivot(_tables(spark, sf_dir), "l_orderkey")


def table_records(spark, sf_dir):
    return R.records(_tables(spark, sf_dir), "l_orderkey")


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def paragraph_context(spark, sf_dir):
    return R.with_context(R.paragraphs(_docs(spark, sf_dir), "doc_id", "text"), "doc_id")


def pseudo_pages(spark, sf_dir):
    return R.pseudo_pages(R.paragraphs(_docs(spark, sf_dir), "doc_id", "text"), "doc_id")


def html_titles_links(spark, sf_dir):
    return R.page_facts(read(spark, sf_dir, "pages"))


def quality_filter_notes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 97).alias("width"), (F.pmod("p_partkey", F.lit(47)) * 101).cast("int").alias("height"))
    return R.quality_notes(p)


def ocr_cleanup(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    k = F.pmod("p_partkey", F.lit(5))
    t = F.when(k == 0, F.translate(F.col("p_size").cast("string"), "015", "OlS")).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(" %"))).when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit(" K"))).when(k == 3, F.concat(F.col("p_size").cast("string"), F.lit(",5"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", T.ocr_cleanup(t, F.lit(0.75)).alias("cleaned"))


def caption_types(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("c"))
    return p.groupBy(T.chart_type_of(F.col("c")).alias("chart_type"), T.caption(F.col("c")).alias("is_caption")).agg(F.count("*").alias("n"))


def nearest_label(spark, sf_dir):
    """Each line's nearest other price point: orders of a customer against a grid of five labels."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey"), "o_orderkey", "o_totalprice")
    grid = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")).select("o_custkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("label"), "top").withColumn("at", F.round(F.col("top") * F.col("label") / 5, 2))
    return J.nearest(o, grid.drop("top"), "o_custkey", "o_totalprice", "at", "o_orderkey", "label", "label").withColumn("distance", F.round("distance", 6))


def nearest_colour(spark, sf_dir):
    """Parts as elements of charts of eighty, four suppliers of each chart as its legend."""
    rgb = lambda key, s="": [F.pmod(F.col(key) * k, F.lit(256)).cast("double").alias(c + s) for c, k in (("r", 37), ("g", 59), ("b", 83))]
    parts = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 80).alias("chart"), "p_partkey", *rgb("p_partkey"))
    legend = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 4).alias("chart"), "s_suppkey", *rgb("s_suppkey", "2"))
    return J.nearest_colour(parts, legend, "chart", "p_partkey", "s_suppkey")


def caption_band_join(spark, sf_dir):
    """Blocks that begin within 100 below a box on the same page: lines of one order."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("bottom"))
    blocks = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("block"), (F.col("l_suppkey") * 10 % 1000).alias("at"))
    return J.band(line, blocks, ["l_orderkey"], F.col("bottom"), F.col("bottom") + 100, "block", ["l_orderkey", "l_linenumber"])


def _boxes(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chart"), F.col("l_linenumber").cast("long").alias("box"), (F.col("l_partkey") % 40).alias("x0"), (F.col("l_suppkey") % 40).alias("y0"), F.col("l_quantity"))
    return l.select("chart", "box", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), (F.col("x0") + 30 + F.col("l_quantity")).alias("x1"), (F.col("y0") + 60.0).alias("y1"))


def iou_pairs(spark, sf_dir):
    return J.overlaps(_boxes(spark, sf_dir), "chart", "box")


def box_suppression(spark, sf_dir):
    return J.suppressed(_boxes(spark, sf_dir), "chart", "box")


def text_overlap_greedy(spark, sf_dir):
    """All words of a conversation's assistant turns against all of its user turns, in order of turns."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "").alias("words"))
    of = lambda role: F.flatten(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "words")))).words)
    return J.greedy_text_overlap(c.groupBy("conv_id").agg(of("assistant").alias("preds"), of("user").alias("gts")), "conv_id")


def nfkc_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_a(T.nfkc(F.col("text")))).alias("normal_md5"))


def _paths(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return o


def polyline_facts(spark, sf_dir):
    return G.path_facts(_paths(spark, sf_dir), "path_id")


def path_curvature(spark, sf_dir):
    return G.curvature(_paths(spark, sf_dir), "path_id")


def path_simplify(spark, sf_dir):
    return G.simplified(_paths(spark, sf_dir), "path_id", 40.0)


def circle_fit(spark, sf_dir):
    return G.circles(_paths(spark, sf_dir), "path_id")


def projection_runs(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chart"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("v")).groupBy("chart", "pos").agg(F.max("v").alias("v"))
    return G.runs_above(p, "chart", 15.0, 3)


def _cells(spark, sf_dir):
    """Grey cells of 16 by 16 for each supplier: how much of the parts that fall on a place was shipped."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
    return line.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 16).alias("x"), (F.col("l_orderkey") % 16).alias("y")).agg(F.sum("l_quantity").cast("double").alias("v"))


def _marks(spark, sf_dir):
    """Foreground cells of 64 by 48 for each supplier."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 7 % 64).alias("x"), (F.col("l_partkey") % 48).alias("y"))


def small_components(spark, sf_dir):
    """Components of an image's marks with their boxes, and whether they are large enough to stay."""
    c = D.components(_marks(spark, sf_dir), ["image"])
    return c.select("image", "area", "x0", "y0", "x1", "y1", "x_sum", "y_sum", (F.col("area") >= 6).alias("kept"))


def cleaned_marks(spark, sf_dir):
    return D.without_small(_marks(spark, sf_dir), ["image"], 6).groupBy("image").agg(F.count("*").alias("cells"), F.sum("x").alias("x_sum"), F.sum("y").alias("y_sum"))


def _skeletons(spark, sf_dir):
    """Thin lines of an order: its lines lie across, every second one has a branch down."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_quantity") / 10).cast("long").alias("n"))
    y, x0 = F.col("l_linenumber") * 6, F.col("l_partkey") % 20
    across = line.select(F.col("l_orderkey").alias("image"), F.explode(F.sequence(x0, x0 + F.col("n"))).alias("x"), y.cast("long").alias("y"))
    down = line.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("image"), (x0 + F.col("l_suppkey") % 4).alias("x"), F.explode(F.sequence(y.cast("long"), (y + 1 + F.col("l_suppkey") % 3).cast("long"))).alias("y"))
    return across.unionByName(down)


def skeleton_paths(spark, sf_dir):
    """Paths of each order's lines between ends and crossings: from where to where, and how long."""
    p = D.path_ends(_skeletons(spark, sf_dir), ["image"])
    return p.select("image", "a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "length", F.col("ends.first").alias("degree"), F.col("ends.last").alias("degree2"), "x_sum")


def _colour_pixels(spark, sf_dir):
    """Pixels of each supplier, with seven bands of colour and some noise."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
    place = line.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 24).alias("x"), (F.col("l_orderkey") % 32).alias("y")).agg(F.sum("l_quantity").cast("long").alias("v"))
    band, noise = F.floor(F.col("x") / 4) + F.floor(F.col("y") / 12), F.col("v") % 7
    return place.select("image", "x", "y", (band * 37 % 200 + noise).cast("int").alias("r"), (band * 91 % 210 + noise).cast("int").alias("g"), (band * 53 % 250 + noise).cast("int").alias("b"))


def colour_clusters(spark, sf_dir):
    """Segments of one colour: k-means over each image's colours, then the touching cells of a cluster."""
    return K.segments(_colour_pixels(spark, sf_dir), "image", least=5)


def curvature_simplify(spark, sf_dir):
    """Points that stay when straight stretches may be further off than curved ones."""
    return V.simplified_by_curvature(_paths(spark, sf_dir), "path_id")


def curve_kinds(spark, sf_dir):
    """The orders of a customer along a line, an arc, a circle, an ellipse, or where they are."""
    w, all_ = Window.partitionBy("path_id").orderBy("pos"), Window.partitionBy("path_id")
    p = _paths(spark, sf_dir).withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(all_))
    t, kind = F.lit(6.0) * F.col("k") / F.col("n"), F.col("path_id") % 5
    x = F.when(kind == 0, F.col("k") * 1.0).when(kind == 1, 5 + 4 * F.cos(t)).when(kind == 2, 4 * F.cos(t / 3)).when(kind == 3, 7 + 6 * F.cos(t)).otherwise(F.col("x"))
    y = F.when(kind == 0, F.col("k") * 2.0).when(kind == 1, 9 + 4 * F.sin(t)).when(kind == 2, 4 * F.sin(t / 3)).when(kind == 3, 3 * F.sin(t)).otherwise(F.col("y"))
    c = V.curve_kinds(p.select("path_id", "pos", x.alias("x"), y.alias("y")), "path_id")
    return c.select("path_id", "n", "kind", F.round("fit", 6).alias("fit"))


def shape_moments(spark, sf_dir):
    m = V.image_moments(_cells(spark, sf_dir), "image")
    return m.select("image", "area", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "elongation")), *(F.round(F.col(f"h{k}") * 10**s, 5).alias(f"h{k}") for k, s in ((1, 3), (2, 9), (3, 12), (4, 12))))


def refined_vertices(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    spots = cells.where("(x * 5 + y * 3) % 7 = 0").select("image", (F.col("x") * 100 + F.col("y")).alias("vertex"), (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.25).alias("y"))
    return V.refined(spots, cells, "image").select("image", "vertex", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


QUERIES = {
    f.__name__: f
    for f in (
        linear_table_parse, table_unpivot, table_records, paragraph_context, pseudo_pages, html_titles_links, quality_filter_notes, ocr_cleanup, caption_types, nearest_label, nearest_colour, caption_band_join,
        iou_pairs, box_suppression, text_overlap_greedy, nfkc_normalize, polyline_facts, path_curvature, path_simplify, circle_fit, projection_runs, colour_clusters, small_components, cleaned_marks, skeleton_paths, curvature_simplify, curve_kinds, shape_moments, refined_vertices,
    )
}

_PARAS = "paras AS (SELECT doc_id, p AS paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> '')"
_MARKS = """m AS (SELECT DISTINCT l_suppkey AS image, l_orderkey * 7 % 64 AS x, l_partkey % 48 AS y, l_suppkey * 10000 + l_orderkey * 7 % 64 * 100 + l_partkey % 48 AS id FROM lineitem),
  e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) d(dx, dy) ON true JOIN m b ON a.image = b.image AND b.x = a.x + dx AND b.y = a.y + dy),
  r(id, root) AS (SELECT id, id FROM m UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
  l AS (SELECT id, min(root) AS root FROM r GROUP BY id), g0 AS (SELECT m.*, l.root FROM m JOIN l USING (id)),
  deep AS (SELECT image, root, count(*) AS area FROM g0 GROUP BY 1, 2)"""
_CELLS = "c AS (SELECT l_suppkey AS image, l_partkey % 16 AS x, l_orderkey % 16 AS y, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL)"
_BOXES = "boxes AS (SELECT l_orderkey AS chart, l_linenumber AS box, (l_partkey % 40)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS y0, l_partkey % 40 + 30 + l_quantity AS x1, l_suppkey % 40 + 60.0::DOUBLE AS y1 FROM lineitem)"
_PATHS = "paths AS (SELECT o_custkey AS path_id, o_orderkey AS pos, (o_orderkey % 1000)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders)"
_RGB = lambda key, s="": ", ".join(f"({key} * {k} % 256)::DOUBLE AS {c}{s}" for c, k in (("r", 37), ("g", 59), ("b", 83)))
ORACLES = {
    "small_components": f"WITH RECURSIVE {_MARKS} SELECT image, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, sum(x)::DOUBLE AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum, count(*) >= 6 AS kept FROM g0 GROUP BY image, root",
    "cleaned_marks": f"WITH RECURSIVE {_MARKS} SELECT image, count(*) AS cells, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum FROM g0 JOIN deep USING (image, root) WHERE area >= 6 GROUP BY image",
    "shape_moments": f"""WITH {_CELLS}, f AS (SELECT image, sum(v) AS area, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy FROM c GROUP BY 1),
      s AS (SELECT image, area, cx, cy, {', '.join(f'sum(v * (x - cx) ** {p} * (y - cy) ** {q}) AS m{p}{q}, sum(v * (x - cx) ** {p} * (y - cy) ** {q}) / area ** {1 + (p + q) / 2} AS n{p}{q}' for p, q in ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)))} FROM c JOIN f USING (image) GROUP BY 1, 2, 3, 4)
      SELECT image, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(least(10, sqrt((m20 + m02 + sqrt(4 * m11 ** 2 + (m20 - m02) ** 2)) / (m20 + m02 - sqrt(4 * m11 ** 2 + (m20 - m02) ** 2)))) / 10, 6) AS elongation,
        round((n20 + n02) * 1e3, 5) AS h1, round(((n20 - n02) ** 2 + 4 * n11 ** 2) * 1e9, 5) AS h2, round(((n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2) * 1e12, 5) AS h3, round(((n30 + n12) ** 2 + (n21 + n03) ** 2) * 1e12, 5) AS h4 FROM s""",
    "refined_vertices": f"""WITH {_CELLS}, s AS (SELECT image, x * 100 + y AS vertex, x, y FROM c WHERE (x * 5 + y * 3) % 7 = 0), k(o, soft, softer, slope, bend) AS (VALUES (-2, 0, 1, 0, 1), (-1, 1, 4, -1, 0), (0, 2, 6, 0, -2), (1, 1, 4, 1, 0), (2, 0, 1, 0, 1)),
      d AS (SELECT s.image, vertex, s.x, s.y, count(*) AS n, sum(v * i.slope * j.soft) AS gx, sum(v * j.slope * i.soft) AS gy, sum(v * i.bend * j.softer) AS hx, sum(v * j.bend * i.softer) AS hy FROM s JOIN k i ON true JOIN k j ON true JOIN c ON c.image = s.image AND c.x = s.x + i.o AND c.y = s.y + j.o GROUP BY ALL)
      SELECT image, vertex, round(x + 0.25 + CASE WHEN n = 25 AND abs(hx) > 1e-6 THEN greatest(-2, least(2, -gx / hx)) ELSE 0 END, 6) AS x, round(y - 0.25 + CASE WHEN n = 25 AND abs(hy) > 1e-6 THEN greatest(-2, least(2, -gy / hy)) ELSE 0 END, 6) AS y FROM d""",
    "linear_table_parse": "SELECT l_orderkey, 'Item,Quantity Discount,col2' AS headers, CAST(count(*) AS INT) AS rows FROM lineitem GROUP BY 1",
    "table_unpivot": """SELECT l_orderkey, s AS series_idx, CASE s WHEN 0 THEN 'Quantity Discount' ELSE 'col2' END AS series_name, CAST(r - 1 AS INT) AS point_idx, 'item' || l_linenumber AS label, CASE s WHEN 0 THEN round(l_quantity) ELSE round(l_discount * 100) END AS value, 0.95::DOUBLE AS confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, printf('%.0f | %.0f', l_quantity, l_discount * 100)) AS r FROM lineitem), (VALUES (0), (1)) v(s)""",
    "table_records": """SELECT l_orderkey, CAST(r - 1 AS INT) AS row, c AS col, ['Item', 'Quantity Discount', 'col2'][c + 1] AS header, CASE c WHEN 0 THEN 'item' || l_linenumber WHEN 1 THEN printf('%.0f', l_quantity) ELSE printf('%.0f', l_discount * 100) || '%' END AS cell
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, printf('%.0f | %.0f', l_quantity, l_discount * 100)) AS r FROM lineitem), (VALUES (0), (1), (2)) v(c)""",
    "paragraph_context": f"""WITH {_PARAS}, a AS (SELECT x.doc_id, x.pos, count(y.pos) AS n, coalesce(sum(length(trim(y.paragraph))), 0) + greatest(count(y.pos) - 1, 0) AS context_chars,
        arg_min(trim(y.paragraph), y.pos) FILTER (regexp_matches(trim(y.paragraph), '(?i)^\\s*(figure|fig\\.?|chart|graph|table|plot|diagram|hình|biểu đồ)\\s*\\d*'))[1:60] AS caption FROM paras x LEFT JOIN paras y ON x.doc_id = y.doc_id AND abs(x.pos - y.pos) BETWEEN 1 AND 3 GROUP BY ALL)
      SELECT doc_id, pos, n, CAST(context_chars AS BIGINT) AS context_chars, caption FROM a""",
    "pseudo_pages": f"WITH {_PARAS} SELECT doc_id, CAST(pos // 15 AS INT) AS page, count(*) AS paragraphs, md5(string_agg(trim(paragraph), chr(10) ORDER BY pos)) AS text_md5 FROM paras GROUP BY 1, 2",
    "html_titles_links": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1], '') AS first_link, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""",
    "quality_filter_notes": """WITH i AS (SELECT p_partkey AS image_id, p_size * 97 AS w, p_partkey % 47 * 101 AS h FROM part), a AS (SELECT *, CASE WHEN h > 0 THEN w::DOUBLE / h ELSE 0 END AS r FROM i),
      n AS (SELECT *, list_filter([CASE WHEN w < 300 THEN 'width_small' END, CASE WHEN h < 300 THEN 'height_small' END, CASE WHEN w > 4096 THEN 'width_large' END, CASE WHEN h > 4096 THEN 'height_large' END, CASE WHEN r < 0.3 THEN 'aspect_small' END, CASE WHEN r > 3 THEN 'aspect_large' END], lambda x: x IS NOT NULL) AS notes FROM a)
      SELECT image_id, array_to_string(notes, ',') AS notes, len(notes) = 0 AS valid, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - len(notes) * 0.2 + least(w * h / 1e6, 1.0) * 0.1 + CASE WHEN r BETWEEN 0.8 AND 1.5 THEN 0.1::DOUBLE ELSE 0 END)), 9) AS score FROM n""",
    "ocr_cleanup": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '%' WHEN 2 THEN p_size || 'K' WHEN 3 THEN p_size || '.5' ELSE p_name END AS cleaned FROM part",
    "nearest_label": """WITH t AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1), g AS (SELECT o_custkey, label, round(top * label / 5, 2) AS spot FROM t, (VALUES (1), (2), (3), (4), (5)) v(label))
      SELECT o_custkey, o_orderkey, label, round(distance, 6) AS distance FROM (SELECT o.o_custkey, o_orderkey, label, abs(o_totalprice - spot) AS distance, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_totalprice - spot), label) AS r FROM orders o JOIN g ON o.o_custkey = g.o_custkey) WHERE r = 1""",
    "nearest_colour": f"""WITH p AS (SELECT p_partkey // 80 AS chart, p_partkey, {_RGB('p_partkey')} FROM part), s AS (SELECT s_suppkey // 4 AS chart, s_suppkey, {_RGB('s_suppkey', '2')} FROM supplier),
      d AS (SELECT p.chart, p_partkey, s_suppkey, sqrt((r - r2) ** 2 + (g - g2) ** 2 + (b - b2) ** 2) AS distance FROM p JOIN s ON p.chart = s.chart)
      SELECT chart, p_partkey, s_suppkey, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, s_suppkey) AS k FROM d) WHERE k = 1""",
    "caption_band_join": "SELECT a.l_orderkey, a.l_linenumber, count(*) AS candidates, min(b.l_linenumber) AS first FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_suppkey * 10 % 1000 BETWEEN a.l_partkey % 1000 AND a.l_partkey % 1000 + 100 GROUP BY 1, 2",
    "iou_pairs": f"""WITH {_BOXES}, j AS (SELECT a.chart, a.box AS box_a, b.box AS box_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM boxes a JOIN boxes b ON a.chart = b.chart AND a.box < b.box)
      SELECT chart, box_a, box_b, round(i / (u - i), 6) AS iou FROM j WHERE round(i / (u - i), 6) > 0.5""",
    "box_suppression": f"""WITH RECURSIVE {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY (x1 - x0) * (y1 - y0) DESC, box, x0, y0) AS k FROM boxes),
      r AS (SELECT DISTINCT chart, 0::BIGINT AS k, []::STRUCT(box BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM boxes
        UNION ALL SELECT r.chart, o.k, CASE WHEN len(list_filter(r.kept, lambda q: greatest(least(o.x1, q.x1) - greatest(o.x0, q.x0), 0) * greatest(least(o.y1, q.y1) - greatest(o.y0, q.y0), 0)
          > 0.5 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(least(o.x1, q.x1) - greatest(o.x0, q.x0), 0) * greatest(least(o.y1, q.y1) - greatest(o.y0, q.y0), 0)))) > 0 THEN r.kept
          ELSE list_append(r.kept, {{'box': o.box::BIGINT, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) END FROM r JOIN o ON o.chart = r.chart AND o.k = r.k + 1),
      l AS (SELECT chart, arg_max(kept, k) AS kept FROM r GROUP BY chart) SELECT chart, b.box AS box FROM (SELECT chart, unnest(kept) AS b FROM l)""",
    "polyline_facts": f"WITH {_PATHS}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY pos)) SELECT path_id, count(*) AS n, round(coalesce(sum(d), 0), 4) AS length, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM s GROUP BY 1",
    "path_curvature": f"""WITH {_PATHS}, s AS (SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
      k AS (SELECT *, abs((x - xa) * (yb - ya) - (xb - xa) * (y - ya)) AS a2, sqrt((x - xa) ** 2 + (y - ya) ** 2) * sqrt((x - xb) ** 2 + (y - yb) ** 2) * sqrt((xa - xb) ** 2 + (ya - yb) ** 2) AS sides FROM s WHERE xa IS NOT NULL AND xb IS NOT NULL)
      SELECT path_id, pos, round(CASE WHEN sides > 1e-10 THEN 2 * a2 / sides ELSE 0 END, 8) AS curvature FROM k""",
    "projection_runs": """WITH p AS (SELECT l_suppkey AS chart, l_orderkey * 10 + l_linenumber AS pos, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY pos) AS a FROM p), u AS (SELECT *, a - row_number() OVER (PARTITION BY chart ORDER BY pos) AS i FROM n WHERE v > 15)
      SELECT chart, min(pos) AS start, max(pos) AS "end", count(*) AS n, max(v) AS peak FROM u GROUP BY chart, i HAVING count(*) >= 3""",
    "caption_types": "SELECT CASE WHEN contains(c, 'bar') OR contains(c, 'histogram') THEN 'bar' WHEN contains(c, 'line') THEN 'line' WHEN contains(c, 'pie') THEN 'pie' WHEN contains(c, 'scatter') THEN 'scatter' WHEN contains(c, 'heat') THEN 'heatmap' WHEN contains(c, 'box') THEN 'box' WHEN contains(c, 'area') THEN 'area' ELSE 'unknown' END AS chart_type, regexp_matches(c, '^\\s*(figure|fig\\.?|chart|graph|table|plot|diagram|hình|biểu đồ)\\s*\\d*') AS is_caption, count(*) AS n FROM (SELECT lower(p_name || ' ' || p_type) AS c FROM part) GROUP BY 1, 2",
}
