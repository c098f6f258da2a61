"""Queries that mine pairs, tokens and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import mining as M
from chartloom.sources import chart_tables as C
from chartloom.sources.tables import read

#: (question, answer, type, has a value) of a line by its part: what a model would ask and say.
FORMS = (
    ("What is the title of this chart?", "The title of the chart is 'Sales {q}'.", "structural", False),
    ("How many bars are shown?", "three bars", "counting", False),
    ("What is the label of the x-axis?", "The x-axis represents Month {q}.", "structural", False),
    ("What is plotted on the vertical axis?", "The y-axis is \"Revenue in USD\".", "structural", False),
    ("What is the range of the y-axis?", "It ranges from approximately {q} to 25", "range", False),
    ("What is the value of item {q}?", "{q}", "extraction", True),
    ("Which item has the highest value?", "Item {q}.", "comparison", False),
    ("What is the maximum value?", "about {q}", "comparison", True),
    ("Which ones are above the mark?", "{q} items exceed it: A, B, C and D", "threshold", False),
    ("What are the four categories shown?", "A, B, C, and D", "structural", False),
    ("At what year does it peak on the horizontal axis?", "In {q}", "extraction", True),
    ("Is it rising?", "Yes; data point {q} is the highest", "trend", False),
    ("How many lines are there?", "There are {q}", "structural", True),
    ("What unit is used?", "The label is 'percent'", "structural", False),
    ("Over what range of x values?", "{q} to 3", "range", False),
)


def _pairs(spark, sf_dir):
    """An order's lines as pairs about its chart; what is asked follows part and order, so that charts differ."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q, k = F.col("l_quantity").cast("int").cast("string"), F.pmod(F.col("l_partkey") * 7 + F.col("l_orderkey"), F.lit(len(FORMS)))
    of = lambda j: F.replace(C.pick(k, tuple(f[j] for f in FORMS)), F.lit("{q}"), q)
    valued = F.element_at(F.array(*(F.lit(f[3]) for f in FORMS)), (k + 1).cast("int"))
    return line.select(F.col("l_orderkey").alias("chart_id"), C.pick(F.col("l_orderkey"), C.CHART_TYPES).alias("chart_type"), C.line_place().alias("qa_idx"), of(0).alias("question"), of(1).alias("answer"), of(2).alias("question_type"), F.when(valued, F.col("l_quantity")).alias("value"))


def mined_titles(spark, sf_dir):
    return M.titles(_pairs(spark, sf_dir))


def mined_counts(spark, sf_dir):
    return M.element_counts(_pairs(spark, sf_dir))


def mined_axes(spark, sf_dir):
    return M.axis_facts(_pairs(spark, sf_dir))


def mined_texts(spark, sf_dir):
    return M.mined_texts(_pairs(spark, sf_dir))


def mined_values(spark, sf_dir):
    """Values read off, with their questions' number."""
    return _pairs(spark, sf_dir).where("question_type = 'extraction' AND value IS NOT NULL").groupBy("chart_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min_by("answer", "qa_idx").alias("first"))


def categorised_numbers(spark, sf_dir):
    t = C.tokens(spark, sf_dir).select("chart_id", "pos", "confidence", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("$"), F.trim("text"), F.when(F.col("pos") % 8 == 0, "k").otherwise(""))).when(F.col("pos") % 4 == 1, F.concat(F.trim("text"), F.lit(".5"))).otherwise(F.col("text")).alias("text"))
    return t.withColumn("x", M.categorised_number(F.col("text"), F.col("confidence"))).where("x IS NOT NULL").select("chart_id", "pos", "x.*")


def _raw_tokens(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 10
    text = (
        F.when(k == 0, F.translate(n, "015", "OlS")).when(k == 1, F.concat(n, F.lit(" %"))).when(k == 2, F.concat(n, F.lit(" K"))).when(k == 3, F.concat(n, F.lit(",5"))).when(k == 4, F.concat(n, F.lit(".000"))).when(k == 5, F.concat(F.lit("  "), F.col("p_name"), F.lit("  x ")))
        .when(k == 6, F.concat(F.lit("1"), F.repeat(F.lit("O"), 17))).when(k == 7, "Oil").when(k == 8, F.concat(F.lit("1,"), n, F.lit("I"))).otherwise(F.col("p_brand"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"), (F.col("p_partkey") % 3 / 4 + 0.4).alias("confidence"))


def ocr_cascade(spark, sf_dir):
    t = _raw_tokens(spark, sf_dir)
    return t.select("p_partkey", M.ocr_corrected(F.col("text"), F.col("confidence")).alias("x")).select("p_partkey", "x.text", "x.correction")


def numeric_fixes(spark, sf_dir):
    t = _raw_tokens(spark, sf_dir)
    return t.select("p_partkey", M.numeric_fixes(F.col("text"), F.col("p_partkey") % 2 == 0).alias("x")).select("p_partkey", "x.text", F.array_join("x.changes", ",").alias("changes"))


def closed_json(spark, sf_dir):
    """Truncated answers closed, and how many of their objects parse."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit('[{"a": '), n, F.lit('}, {"a": 2}, {"a'))).when(k == 1, F.concat(F.lit('{"a": '), n)).when(k == 2, F.concat(F.lit('{"a": '), n, F.lit("}"))).otherwise(F.lit("none"))
    p = read(spark, sf_dir, "part").select("p_partkey", M.closed_json(text).alias("closed"))
    return p.select("p_partkey", "closed", F.coalesce(F.size(F.from_json(F.when(F.col("closed").startswith("["), F.col("closed")), "array<struct<a:int>>")), F.lit(0)).alias("objects"))


def table_json(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit('Here:\n```json\n{"headers": ["x", "y"], "rows": [["a", "'), n, F.lit('"], ["b", "2"]]}\n```'))).when(k == 1, F.concat(F.lit('[["x", "y", "z"], ["a", "'), n, F.lit('", "c"]]')))
        .when(k == 2, F.lit('{"headers": [], "rows": []}')).otherwise("x | y<0x0A>a | 1")
    )
    t = read(spark, sf_dir, "part").select("p_partkey", M.table_json(text).alias("t"))
    return t.select("p_partkey", F.array_join("t.headers", ",").alias("headers"), F.size("t.rows").alias("rows"), F.element_at("t.rows", 1)[1].alias("cell"))


def model_pairs(spark, sf_dir):
    """Answers of a model with two pairs each: fenced objects, bare arrays, and broken ones."""
    o = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    kind = C.pick(F.col("p_partkey"), ("TREND", "extraction", "odd", "multi_hop", "range"))
    one = F.concat(F.lit('{"question": "q'), F.col("p_size").cast("string"), F.lit('", "answer": "a", "question_type": "'), kind, F.lit('", "confidence": '), ((F.col("p_size") - 5) / 40).cast("string"), F.lit(', "reasoning_method": "calculation"}'))
    two = F.concat(F.lit('{"question": "r", "answer": "b", "difficulty": '), (F.col("p_size") % 5).cast("string"), F.lit("}"))
    body = F.concat(F.lit("["), one, F.lit(", "), two, F.lit(",]"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('```json\n{"qa_pairs": '), body, F.lit("}\n```"))).when(F.col("p_partkey") % 3 == 1, body).otherwise(F.concat(body, F.lit("{{")))
    return M.model_pairs(o.where("p_partkey % 3 < 2").select("p_partkey", text.alias("text")), "p_partkey", "text").withColumn("confidence", F.round("confidence", 6))


def answer_parts(spark, sf_dir):
    """Answers with a verification block and two pairs: whole, fenced, bare, cut off in the second pair, cut off in the block, and no JSON."""
    o = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    block = F.concat(F.lit('"verification": {"is_chart": true, "size": '), n, F.lit("}"))
    one, two = F.concat(F.lit('{"question": "What is '), F.col("p_name"), F.lit('?", "answer": "'), n, F.lit('"}')), F.lit('{"question": "r", "answer": "b", "difficulty": 4,}')
    body = F.concat(F.lit("{"), block, F.lit(', "qa_pairs": ['), one, F.lit(", "), two, F.lit(",]}"))
    text = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
        .when(k == 3, F.concat(F.lit("{"), block, F.lit(', "qa_pairs": ['), one, F.lit(', {"question": "r", "answ'))).when(k == 4, F.concat(F.lit('{"verification": {"is_chart": tr'))).otherwise("no answer")
    )
    a = M.answer_parts(o.select("p_partkey", text.alias("text")), "p_partkey", "text")
    return a.select("p_partkey", "state", F.col("verification")["size"].alias("size"), F.size("pairs").alias("pairs"), F.get("pairs", F.lit(0))["question"].alias("first"), F.get("pairs", F.lit(1))["difficulty"].alias("difficulty"))


QUERIES = {f.__name__: f for f in (mined_titles, mined_counts, mined_axes, mined_texts, mined_values, categorised_numbers, ocr_cascade, numeric_fixes, closed_json, table_json, model_pairs, answer_parts)}

_s = lambda x: "'" + x.replace("'", "''") + "'"
_arr = lambda j: "[" + ", ".join(_s(f[j]) for f in FORMS) + "]"
_K = f"CAST((l_partkey * 7 + l_orderkey) % {len(FORMS)} + 1 AS INT)"
_PAIRS = f"""pairs AS (SELECT l_orderkey AS chart_id, {list(C.CHART_TYPES)}[CAST(l_orderkey % 8 + 1 AS INT)] AS chart_type, {C.LINE_SQL} AS qa_idx, {_K} - 1 AS k, CAST(l_quantity AS INT) AS q, replace({_arr(0)}[{_K}], '{{q}}', CAST(l_quantity AS INT)::VARCHAR) AS question,
    replace({_arr(1)}[{_K}], '{{q}}', CAST(l_quantity AS INT)::VARCHAR) AS answer, {_arr(2)}[{_K}] AS question_type, CASE WHEN {[f[3] for f in FORMS]}[{_K}] THEN l_quantity END AS value FROM lineitem)"""
_TOK = "WITH p AS (SELECT *, p_partkey % 10 AS k, p_size::VARCHAR AS n FROM part), t AS (SELECT p_partkey, p_size, k, CASE k WHEN 0 THEN translate(n, '015', 'OlS') WHEN 1 THEN n || ' %' WHEN 2 THEN n || ' K' WHEN 3 THEN n || ',5' WHEN 4 THEN n || '.000' WHEN 5 THEN '  ' || p_name || '  x ' WHEN 6 THEN '1' || repeat('O', 17) WHEN 7 THEN 'Oil' WHEN 8 THEN '1,' || n || 'I' ELSE p_brand END AS text, p_partkey % 3 / 4 + 0.4 AS confidence FROM p)"
# what each form says, in plain terms: 0 title, 1 three by counting, 2 x label, 3 y label, 4 y range q..25, 5 y value q, 6 item q, 7 y_max q, 8 q items, listed 4, 9 four by name, 10 x value q, 11 data point q, 12 q lines, 13 unit, 14 a range of x
ORACLES = {
    "mined_titles": f"WITH {_PAIRS} SELECT chart_id, 'Sales ' || arg_min(q, qa_idx) AS title FROM pairs WHERE k = 0 GROUP BY 1",
    "mined_counts": f"""WITH {_PAIRS}, a AS (SELECT chart_id, chart_type, count(*) FILTER (k = 1) > 0 AS s1, arg_min(CASE WHEN k = 1 THEN 3 ELSE q END, qa_idx) FILTER (k = 1 OR (k = 12 AND q > 0)) AS s2, count(*) FILTER (k = 9) > 0 AS s3, max(q) FILTER (k = 11) AS points,
        len(list_distinct(list(CASE k WHEN 5 THEN 'item ' || q WHEN 6 THEN 'item ' || q END) FILTER (k IN (5, 6)))) AS items, arg_min(CASE WHEN 4 >= q THEN 4 ELSE q END, qa_idx) FILTER (k = 8 AND (4 >= q OR q BETWEEN 2 AND 50)) AS over, count(DISTINCT question) FILTER (k IN (5, 10) AND value > 0) AS shares FROM pairs GROUP BY ALL),
      b AS (SELECT chart_id, CASE WHEN chart_type IN ('bar', 'histogram') THEN coalesce(CASE WHEN points >= 2 THEN points END, CASE WHEN items >= 2 THEN items END, over) WHEN chart_type = 'pie' AND shares > 0 THEN greatest(shares, 2) END AS own, s1, s2, s3 FROM a)
      SELECT chart_id, CAST(CASE WHEN s1 THEN 3 WHEN s2 IS NOT NULL THEN s2 WHEN s3 THEN 4 ELSE own END AS INT) AS n, CASE WHEN s1 THEN 'counting' WHEN s2 IS NOT NULL THEN 'question' WHEN s3 THEN 'structural' ELSE 'type' END AS "by" FROM b WHERE s1 OR s2 IS NOT NULL OR s3 OR own IS NOT NULL""",
    "mined_axes": f"""WITH {_PAIRS}, a AS (SELECT chart_id, chart_type, arg_max('Month ' || q, qa_idx) FILTER (k = 2) AS x_label, max('Revenue in USD') FILTER (k = 3) AS y_label,
        arg_max(least(q, CASE k WHEN 4 THEN 25 ELSE 3 END)::DOUBLE, qa_idx) FILTER (k IN (4, 14)) AS y0, arg_max(CASE k WHEN 4 THEN greatest(q, 25) WHEN 14 THEN greatest(q, 3) ELSE q END::DOUBLE, qa_idx) FILTER (k IN (4, 14) OR (k = 7 AND chart_type IN ('bar', 'line', 'area', 'histogram', 'box'))) AS y1,
        min(q) FILTER (k = 10) AS xl, max(q) FILTER (k = 10) AS xh, min(q) FILTER (k = 5) AS yl, max(q) FILTER (k = 5) AS yh, count(*) FILTER (k = 5) AS ny FROM pairs GROUP BY ALL),
      b AS (SELECT chart_id, chart_type, x_label, y_label, CASE WHEN chart_type IN ('scatter', 'line', 'area') THEN xl END::DOUBLE AS x0, CASE WHEN chart_type IN ('scatter', 'line', 'area') THEN xh END::DOUBLE AS x1, coalesce(y0, CASE WHEN ny >= 2 THEN yl END::DOUBLE) AS y0, coalesce(y1, CASE WHEN ny >= 2 THEN yh END::DOUBLE) AS y1 FROM a),
      c AS (SELECT * REPLACE (coalesce(y0, CASE WHEN chart_type IN ('bar', 'histogram') AND y1 IS NOT NULL THEN 0.0::DOUBLE END) AS y0) FROM b),
      d AS (SELECT chart_id, CASE WHEN x0 <> x1 OR x1 IS NULL THEN least(x0, coalesce(x1, x0)) END AS x_min, CASE WHEN x0 <> x1 OR x0 IS NULL THEN greatest(x1, coalesce(x0, x1)) END AS x_max, CASE WHEN y0 <> y1 THEN least(y0, y1) WHEN y1 IS NULL THEN y0 END AS y_min, CASE WHEN y0 <> y1 THEN greatest(y0, y1) WHEN y0 IS NULL THEN y1 END AS y_max, x_label, y_label FROM c)
      SELECT * FROM d WHERE coalesce(x_min, x_max, y_min, y_max) IS NOT NULL OR x_label IS NOT NULL OR y_label IS NOT NULL""",
    "mined_texts": f"""WITH {_PAIRS}, t AS (SELECT chart_id, -1 AS o, 'Sales ' || arg_min(q, qa_idx) AS text, 'title' AS role FROM pairs WHERE k = 0 GROUP BY 1 UNION ALL SELECT chart_id, qa_idx, CASE k WHEN 2 THEN 'Month ' || q WHEN 3 THEN 'Revenue in USD' ELSE 'percent' END, CASE k WHEN 2 THEN 'x_axis_label' WHEN 3 THEN 'y_axis_label' ELSE 'axis_label' END FROM pairs WHERE k IN (2, 3, 13)),
      f AS (SELECT chart_id, min(o) AS o, arg_min(text, o) AS text, arg_min(role, o) AS role FROM t GROUP BY chart_id, lower(text)) SELECT chart_id, CAST(row_number() OVER (PARTITION BY chart_id ORDER BY o) - 1 AS INT) AS place, text, role FROM f""",
    "mined_values": f"WITH {_PAIRS} SELECT chart_id, count(*) AS n, sum(value) AS total, arg_min(answer, qa_idx) AS first FROM pairs WHERE k IN (5, 10) GROUP BY 1",
    "categorised_numbers": rf"""WITH {C.TOKENS_SQL}, t AS (SELECT chart_id, pos, confidence, trim(CASE pos % 4 WHEN 0 THEN '$' || trim(text) || CASE WHEN pos % 8 = 0 THEN 'k' ELSE '' END WHEN 1 THEN trim(text) || '.5' ELSE text END) AS s FROM tokens),
      k AS (SELECT *, CASE WHEN regexp_matches(s, '^([\d,.]+)\s*%$') THEN 'percent' WHEN regexp_matches(s, '^[$£€]([\d,.]+)[KMBkmb]?$') THEN 'currency' WHEN regexp_matches(s, '^([\d,]+)$') THEN 'integer' WHEN regexp_matches(s, '^([\d,]*\.\d+)$') THEN 'decimal' END AS kind, TRY_CAST(regexp_replace(s, '[^0-9.]', '', 'g') AS DOUBLE) AS v FROM t)
      SELECT chart_id, pos, kind, v * CASE WHEN kind = 'currency' AND right(s, 1) = 'k' THEN 1000 ELSE 1 END AS value FROM k WHERE confidence >= 0.5 AND kind IS NOT NULL AND v IS NOT NULL""",
    "ocr_cascade": f"""{_TOK} SELECT p_partkey, CASE k WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '%' WHEN 2 THEN p_size || 'K' WHEN 3 THEN p_size || '.5' WHEN 4 THEN p_size || '000' WHEN 5 THEN regexp_replace(trim(text), '\\s+', ' ', 'g') WHEN 8 THEN CASE WHEN p_size < 10 THEN '1.' ELSE '1,' END || p_size || '1' ELSE text END AS text,
        CASE WHEN k = 0 THEN CASE WHEN text <> p_size::VARCHAR THEN 'char_substitution' END WHEN k IN (1, 2, 5) THEN 'cleanup' WHEN k = 3 THEN 'decimal_format' WHEN k = 4 THEN 'thousand_separator' WHEN k = 8 THEN 'char_substitution' END AS correction FROM t WHERE NOT (k = 0 AND regexp_matches(text, '^[OlS]+$') AND confidence >= 0.8)
        UNION ALL SELECT p_partkey, text, NULL FROM t WHERE k = 0 AND regexp_matches(text, '^[OlS]+$') AND confidence >= 0.8""",
    "numeric_fixes": f"{_TOK} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN translate(text, 'OolI', '0011') ELSE text END AS text, CASE WHEN p_partkey % 2 = 0 THEN concat_ws(',', CASE WHEN contains(text, 'O') THEN '''O'' -> ''0''' END, CASE WHEN contains(text, 'o') THEN '''o'' -> ''0''' END, CASE WHEN contains(text, 'l') THEN '''l'' -> ''1''' END, CASE WHEN contains(text, 'I') THEN '''I'' -> ''1''' END) ELSE '' END AS changes FROM t",
    "answer_parts": """SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 'whole' WHEN p_partkey % 6 = 3 THEN 'salvaged' ELSE 'none' END AS state, CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN p_size::VARCHAR END AS size,
      CASE p_partkey % 6 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 0 ELSE 2 END AS pairs, CASE WHEN p_partkey % 6 < 4 THEN 'What is ' || p_name || '?' END AS first, CASE WHEN p_partkey % 6 < 3 THEN 4 END AS difficulty FROM part""",
    "closed_json": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[{"a": ' || p_size || '}, {"a": 2}]' WHEN 1 THEN '{"a": ' || p_size || '}' END AS closed, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 0 END AS objects FROM part""",
    "table_json": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x,y' WHEN 1 THEN 'x,y,z' END AS headers, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS rows, CASE WHEN p_partkey % 4 < 2 THEN p_size::VARCHAR END AS cell FROM part",
    "model_pairs": """WITH p AS (SELECT p_partkey, p_size, ['trend', 'extraction', 'extraction', 'multi_hop', 'range'][CAST(p_partkey % 5 + 1 AS INT)] AS kind, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_size - 5)::DOUBLE / 40)) AS c FROM part WHERE p_partkey % 3 < 2)
      SELECT p_partkey, 0 AS n, 'q' || p_size AS question, kind AS question_type, 'calculation' AS method, round(c, 6) AS confidence, CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' WHEN c >= 0.5 THEN 'low' ELSE 'uncertain' END AS level, CASE kind WHEN 'trend' THEN 2 WHEN 'extraction' THEN 1 WHEN 'multi_hop' THEN 4 ELSE 3 END AS difficulty FROM p
      UNION ALL SELECT p_partkey, 1, 'r', 'extraction', 'direct_read', 0.8, 'medium', CAST(p_size % 5 AS INT) FROM p""",
}
