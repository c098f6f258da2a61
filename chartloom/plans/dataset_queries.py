"""Queries of training-set building and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.operators import calibrate as K
from chartloom.operators import dataset as D
from chartloom.sources import chart_tables as C
from chartloom.sources.files import shared_folder
from chartloom.sources.tables import QA_SQL, qa_pairs, read


def qa_pairs_from_turns(spark, sf_dir):
    q = qa_pairs(spark, sf_dir).where("trim(question) <> '' AND trim(answer) <> ''")
    return q.select("conv_id", "qa_idx", "question_type", "difficulty", F.length("question").alias("q_len"), F.length("answer").alias("a_len"))


def qa_feature_left_join(spark, sf_dir):
    """Documents with their labels where they have any, by language."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    j = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"))


def coverage_semi(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def orphan_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def curriculum_distribution(spark, sf_dir):
    stage = F.when(F.col("question_type").isin("extraction", "counting"), 1).when(F.col("question_type").isin("comparison", "trend"), 2).otherwise(3)
    return qa_pairs(spark, sf_dir).groupBy(stage.alias("stage"), "question_type").agg(F.count("*").alias("n"))


def pivot_type_difficulty(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") <= 10, "easy").when(F.col("p_size") <= 30, "medium").otherwise("hard").alias("d"))
    out = p.groupBy("p_brand").pivot("d", ["easy", "medium", "hard"]).agg(F.count("p_brand")).na.fill(0)
    return out.withColumn("total", F.col("easy") + F.col("medium") + F.col("hard"))


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source")


def per_type_cap(spark, sf_dir):
    return D.cap_per_group(_docs(spark, sf_dir), "source", "doc_id", 20)


def fixed_per_type(spark, sf_dir):
    return D.cap_per_group(_docs(spark, sf_dir), "lang", "doc_id", 50, seed=7)


def stratified_sample(spark, sf_dir):
    return D.stratified(_docs(spark, sf_dir), ["lang", "source"], "doc_id", 200)


def group_split(spark, sf_dir):
    return D.group_split(_docs(spark, sf_dir), "doc_id")


def class_ratio_split(spark, sf_dir):
    return D.ratio_split(_docs(spark, sf_dir), "lang", "doc_id")


def simple_split(spark, sf_dir):
    return D.simple_split(_docs(spark, sf_dir), "doc_id")


def class_ratio_cap(spark, sf_dir):
    return D.ratio_split(_docs(spark, sf_dir), "lang", "doc_id", most=60)


def stratified_top_up(spark, sf_dir):
    return D.stratified(_docs(spark, sf_dir), ["lang", "source"], "doc_id", 150, least=2, top_up=True)


def negative_sample(spark, sf_dir):
    return D.negatives(_docs(spark, sf_dir), F.col("lang") == "en", "doc_id", 0.3)


def head_per_type(spark, sf_dir):
    return D.head_per_type(_docs(spark, sf_dir), "source", "doc_id", 60)


def audit_sample(spark, sf_dir):
    """Thirty of each language, seeded."""
    return D.cap_per_group(_docs(spark, sf_dir), "lang", "doc_id", 30, seed=3).groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def test_set(spark, sf_dir):
    """A test set of question pairs, written as JSON and loaded three ways: all of it, a plain sample, and one by question type and difficulty."""
    folder = f"{shared_folder(spark)}/test"
    qa_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("qa_idx")).alias("id"), "question", "answer", "question_type", "difficulty").write.json(folder)
    rows = spark.read.schema("id long, question string, answer string, question_type string, difficulty int").json(folder)
    loads = {"all": D.test_rows(rows, "id"), "plain": D.test_rows(rows, "id", 50), "stratified": D.test_rows(rows, "id", 60, ["question_type", "difficulty"]), "more": D.test_rows(rows, "id", 10**9)}
    out = None
    for how, df in loads.items():
        one = df.select(F.lit(how).alias("load"), "id", F.md5("answer").alias("answer_md5"))
        out = one if out is None else out.unionByName(one)
    return out


#: How many charts of each type and difficulty a benchmark has.
QUOTAS = {"line": {"simple": 3, "moderate": 2, "complex": 2}, "bar": {"simple": 3, "moderate": 2, "complex": 1}, "pie": {"simple": 2, "moderate": 2}, "heatmap": {"simple": 1, "complex": 2}}


def quota_sample(spark, sf_dir):
    """Charts by type and difficulty, from papers (customers) not used yet where there are any."""
    c = C.charts(spark, sf_dir).select("chart_id", "chart_type", "difficulty").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chart_id"), F.col("o_custkey").alias("paper")), "chart_id")
    return D.quota_sample(c, "chart_type", "difficulty", "chart_id", "paper", QUOTAS, presample=50)


def registry_upsert(spark, sf_dir):
    """The latest order of each customer."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return D.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "at").drop("at", "o_orderdate")


def insert_if_absent(spark, sf_dir):
    old = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_totalprice")
    new = read(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").select("o_custkey", "o_orderkey", "o_totalprice")
    return D.insert_if_absent(old, new, "o_custkey")


def _ticks(spark, sf_dir):
    """A priority's and year's months as ticks: the month's number is the pixel, its mean price the value."""
    o = read(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string")).alias("axis_id"), F.month("o_orderdate").cast("double").alias("pixel"), "o_totalprice")
    return o.groupBy("axis_id", "pixel").agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


def ols_fit(spark, sf_dir):
    return K.ols(_ticks(spark, sf_dir))


def theil_sen_fit(spark, sf_dir):
    return K.theil_sen(_ticks(spark, sf_dir))


def ransac_fit(spark, sf_dir):
    return K.ransac_pairs(_ticks(spark, sf_dir), tolerance=5000.0)


def log_vs_linear(spark, sf_dir):
    return K.linear_or_log(_ticks(spark, sf_dir), gain=0.001)


def axis_map_clamp(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    px = (F.pmod("p_partkey", F.lit(160)) - 30).cast("double")
    v = N.axis_value(px, F.lit(0.0), F.lit(100.0), F.col("p_size").cast("double"), F.col("p_size") * 10.0, F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 == 0)
    v = F.round(v, 9)  # the bounds themselves must compare alike
    held, sure = N.clamped(v, F.col("p_size").cast("double"), F.col("p_size") * 10.0, F.lit(0.9))
    return p.select("p_partkey", F.round(v, 6).alias("raw"), F.round(held, 6).alias("value"), F.round(sure, 6).alias("confidence"))


def scale_patterns(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", F.pow(F.lit(2.0), F.pmod("p_partkey", F.lit(5)).cast("double")).alias("two"), F.col("p_size").cast("double").alias("size"))
    a = K.scale_pattern(p.select(F.concat("p_brand", F.lit("/2")).alias("axis_id"), F.col("two").alias("v")), "axis_id", "v")
    return a.union(K.scale_pattern(p.select(F.concat("p_brand", F.lit("/s")).alias("axis_id"), F.col("size").alias("v")), "axis_id", "v"))


def colour_series(spark, sf_dir):
    """Lines of an order as elements: the ship flag is the colour, the part key the place."""
    e = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return K.numbered_series(e, "l_orderkey", "l_returnflag", "l_partkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (qa_pairs_from_turns, qa_feature_left_join, coverage_semi, orphan_anti, curriculum_distribution, pivot_type_difficulty, per_type_cap, fixed_per_type, stratified_sample, group_split, class_ratio_split, simple_split, class_ratio_cap, stratified_top_up, negative_sample, head_per_type, audit_sample, test_set, quota_sample, registry_upsert, insert_if_absent, ols_fit, theil_sen_fit, ransac_fit, log_vs_linear, axis_map_clamp, scale_patterns, colour_series)}

_TICKS = "ticks AS (SELECT o_orderpriority || '/' || year(o_orderdate) AS axis_id, month(o_orderdate)::DOUBLE AS pixel, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"
_PAIRS = "pairs AS (SELECT a.axis_id, a.pixel AS p, b.pixel AS q, a.value AS v, (b.value - a.value) / (b.pixel - a.pixel) AS m FROM ticks a JOIN ticks b ON a.axis_id = b.axis_id AND b.pixel > a.pixel)"


def _split(a, b):
    return f"CASE WHEN r <= floor(n * {a}::DOUBLE) THEN 'train' WHEN r <= floor(n * {a}::DOUBLE) + floor(n * {b}::DOUBLE) THEN 'val' ELSE 'test' END AS split"


def _rank(by, seed=42):
    return f"row_number() OVER ({by}ORDER BY md5('{seed}:' || doc_id), doc_id)"


ORACLES = {
    "qa_pairs_from_turns": f"WITH {QA_SQL} SELECT conv_id, qa_idx, question_type, difficulty, length(question) AS q_len, length(answer) AS a_len FROM qa WHERE trim(question) <> '' AND trim(answer) <> ''",
    "qa_feature_left_join": "SELECT lang, count(*) AS n, count(quality) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "coverage_semi": "SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source",
    "orphan_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "curriculum_distribution": f"WITH {QA_SQL} SELECT CASE WHEN question_type IN ('extraction', 'counting') THEN 1 WHEN question_type IN ('comparison', 'trend') THEN 2 ELSE 3 END AS stage, question_type, count(*) AS n FROM qa GROUP BY ALL",
    "pivot_type_difficulty": "SELECT p_brand, count(*) FILTER (p_size <= 10) AS easy, count(*) FILTER (p_size > 10 AND p_size <= 30) AS medium, count(*) FILTER (p_size > 30) AS hard, count(*) AS total FROM part GROUP BY 1",
    "per_type_cap": f"SELECT doc_id, lang, source FROM (SELECT *, {_rank('PARTITION BY source ')} AS r FROM documents) WHERE r <= 20",
    "fixed_per_type": f"SELECT doc_id, lang, source FROM (SELECT *, {_rank('PARTITION BY lang ', 7)} AS r FROM documents) WHERE r <= 50",
    "test_set": f"""WITH {QA_SQL}, t AS (SELECT conv_id * 1000 + qa_idx AS id, answer, question_type, difficulty FROM qa), r AS (SELECT *, row_number() OVER (PARTITION BY question_type, difficulty ORDER BY md5('42:' || id), id) AS r, count(*) OVER (PARTITION BY question_type, difficulty) AS n, count(*) OVER () AS a FROM t)
      SELECT how AS load, id, md5(answer) AS answer_md5 FROM (SELECT 'all' AS how, id, answer FROM t UNION ALL SELECT 'more', id, answer FROM t UNION ALL (SELECT 'plain', id, answer FROM t ORDER BY md5('42:' || id), id LIMIT 50)
        UNION ALL (SELECT 'stratified', id, answer FROM r WHERE r <= greatest(1, round_even(n * 60.0::DOUBLE / a, 0)) ORDER BY r, md5('42:' || id), id LIMIT 60))""",
    "stratified_sample": f"SELECT doc_id, lang, source FROM (SELECT *, {_rank('PARTITION BY lang, source ')} AS r, count(*) OVER (PARTITION BY lang, source) AS n, count(*) OVER () AS a FROM documents) WHERE r <= greatest(1, round_even(n * 200.0::DOUBLE / a, 0)) ORDER BY r, md5('42:' || doc_id), doc_id LIMIT 200",
    "group_split": f"SELECT doc_id, lang, source, {_split(0.85, 0.10)} FROM (SELECT *, {_rank('')} AS r, count(*) OVER () AS n FROM documents)",
    "class_ratio_split": f"SELECT doc_id, lang, source, {_split(0.8, 0.1)} FROM (SELECT *, {_rank('PARTITION BY lang ')} AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)",
    "registry_upsert": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "insert_if_absent": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "simple_split": f"SELECT doc_id, lang, source, {_split(0.70, 0.15)} FROM (SELECT *, {_rank('')} AS r, count(*) OVER () AS n FROM documents)",
    "class_ratio_cap": f"SELECT * FROM (SELECT doc_id, lang, source, {_split(0.8, 0.1)}, r FROM (SELECT *, {_rank('PARTITION BY lang ')} AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)) WHERE split <> 'train' OR r <= 60".replace("SELECT * FROM (", "SELECT doc_id, lang, source, split FROM ("),
    "stratified_top_up": f"""SELECT doc_id, lang, source FROM (SELECT *, {_rank('PARTITION BY lang, source ')} AS r, count(*) OVER (PARTITION BY lang, source) AS n, count(*) OVER () AS a FROM documents) ORDER BY r > greatest(2, round_even(n * 150.0::DOUBLE / a, 0)), r, md5('42:' || doc_id), doc_id LIMIT 150""",
    "negative_sample": f"""WITH m AS (SELECT doc_id, lang, source, lang = 'en' AS positive FROM documents), r AS (SELECT *, {_rank('PARTITION BY positive ')} AS r FROM m) SELECT doc_id, lang, source, positive FROM r WHERE positive OR r <= (SELECT floor(count(*) * 0.3::DOUBLE) FROM m WHERE positive)""",
    "head_per_type": "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= greatest(1, 60 // (SELECT count(DISTINCT source) FROM documents)) ORDER BY source, doc_id LIMIT 60",
    "audit_sample": f"SELECT lang, count(*) AS n, min(doc_id) AS first FROM (SELECT *, {_rank('PARTITION BY lang ', 3)} AS r FROM documents) WHERE r <= 30 GROUP BY 1",
    "ols_fit": f"WITH {_TICKS} SELECT axis_id, count(*) AS n, round(regr_slope(value, pixel), 6) AS slope, round(regr_intercept(value, pixel), 6) AS intercept, round(regr_r2(value, pixel), 6) AS r2, round(sqrt(greatest(0.0, (1 - regr_r2(value, pixel)) * regr_syy(value, pixel) / count(*))), 4) AS residual_sd FROM ticks GROUP BY 1 HAVING count(*) >= 2",
    "theil_sen_fit": f"WITH {_TICKS}, {_PAIRS}, s AS (SELECT axis_id, median(m) AS slope FROM pairs GROUP BY 1) SELECT axis_id, round(any_value(slope), 6) AS slope, round(median(value - slope * pixel), 6) AS intercept FROM ticks JOIN s USING (axis_id) GROUP BY 1",
    "ransac_fit": f"""WITH {_TICKS}, {_PAIRS}, c AS (SELECT l.axis_id, p, q, v, m, count(*) FILTER (abs(t.value - (v + m * (t.pixel - p))) < 5000.0) AS inliers, count(*) AS n FROM pairs l JOIN ticks t ON l.axis_id = t.axis_id GROUP BY ALL)
      SELECT axis_id, n, inliers, round(m, 6) AS slope, round(v - m * p, 4) AS intercept FROM (SELECT *, row_number() OVER (PARTITION BY axis_id ORDER BY inliers DESC, p, q) AS r FROM c) WHERE r = 1""",
    "log_vs_linear": f"WITH {_TICKS} SELECT axis_id, round(regr_r2(value, pixel), 6) AS r2_linear, round(regr_r2(log10(value), pixel), 6) AS r2_log, CASE WHEN regr_r2(log10(value), pixel) - regr_r2(value, pixel) > 0.001 THEN 'log' ELSE 'linear' END AS scale FROM ticks GROUP BY 1",
    "axis_map_clamp": """WITH a AS (SELECT p_partkey, p_size::DOUBLE AS lo, p_size * 10.0::DOUBLE AS hi, CASE WHEN p_partkey % 3 = 0 THEN 1 - (p_partkey % 160 - 30)::DOUBLE / 100 ELSE (p_partkey % 160 - 30)::DOUBLE / 100 END AS f FROM part),
      b AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN round(pow(10.0::DOUBLE, log10(lo) + f * (log10(hi) - log10(lo))), 9) ELSE round(lo + f * (hi - lo), 9) END AS raw FROM a), c AS (SELECT *, least(greatest(raw, lo - (hi - lo) * 0.1::DOUBLE), hi + (hi - lo) * 0.1::DOUBLE) AS held FROM b)
      SELECT p_partkey, round(raw, 6) AS raw, round(held, 6) AS value, round(CASE WHEN raw >= lo AND raw <= hi THEN 0.9::DOUBLE WHEN held = raw THEN 0.9::DOUBLE * 0.7 ELSE 0.9::DOUBLE * 0.5 END, 6) AS confidence FROM c""",
    "scale_patterns": """WITH v AS (SELECT p_brand || '/2' AS axis_id, pow(2.0::DOUBLE, p_partkey % 5) AS v FROM part UNION ALL SELECT p_brand || '/s', p_size::DOUBLE FROM part), d AS (SELECT axis_id, list_sort(list(DISTINCT v)) AS l FROM v GROUP BY 1)
      SELECT axis_id, CAST(len(l) AS INT) AS n, CASE WHEN len(l) < 2 THEN 'unknown' WHEN l[1] > 0 AND len(list_filter(range(1, len(l)), lambda i: abs(l[i + 1] / l[i] - 10) >= 0.1)) = 0 THEN 'log10'
        WHEN l[1] > 0 AND len(list_filter(range(1, len(l)), lambda i: abs(l[i + 1] / l[i] - 2) >= 0.02)) = 0 THEN 'log2' WHEN l[1] >= 0 AND l[len(l)] <= 1 THEN 'ratio' WHEN l[1] >= 0 AND l[len(l)] <= 100 THEN 'percentage' ELSE 'linear' END AS pattern FROM d""",
    "colour_series": """SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY seen) - 1 AS series_idx, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber) - 1 AS point_idx
      FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS seen FROM lineitem)""",
}
