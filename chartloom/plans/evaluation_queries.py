"""Queries of the evaluation lab."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T
from chartloom.operators import evaluate as E
from chartloom.sources.tables import QA_SQL, qa_pairs, read

def text_metrics(spark, sf_dir):
    return E.text_metrics(qa_pairs(spark, sf_dir), "answer", "question", ["conv_id", "qa_idx"])


def bleu1(spark, sf_dir):
    p = qa_pairs(spark, sf_dir)
    return p.select("conv_id", "qa_idx", F.round(T.bleu_1(F.col("answer"), F.col("question")), 6).alias("bleu_1"))


def fuzzy_match(spark, sf_dir):
    p = qa_pairs(spark, sf_dir)
    return p.select("conv_id", "qa_idx", T.fuzzy_match(F.col("question"), F.col("answer")).alias("matched"))


def latency_nearest_rank(spark, sf_dir):
    return E.latency_report(read(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


def error_rate_by_type(spark, sf_dir):
    return E.error_rates(read(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", 10.0)


def worst20(spark, sf_dir):
    return E.worst(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id", "value")


def _predicted(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 400).cast("int").alias("pred"))
    return read(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")


def confusion_matrix(spark, sf_dir):
    return E.confusion(_predicted(spark, sf_dir), "quality", "pred")


def prf1(spark, sf_dir):
    return E.class_report(_predicted(spark, sf_dir), "quality", "pred")


def class_weights(spark, sf_dir):
    return E.class_weights(read(spark, sf_dir, "embeddings").select("label"), "label")


def type_distribution_sets(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return E.grouping_counts(o.join(c, F.col("o_custkey") == F.col("c_custkey")), ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


def cross_models_metrics_pivot(spark, sf_dir):
    """Every line's price under four discount models, averaged by flag: models in columns."""
    line = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount")
    models = spark.createDataFrame([("m0", 0.0), ("m1", 0.5), ("m2", 1.0), ("m3", 2.0)], "model string, k double")
    priced = line.join(F.broadcast(models)).withColumn("v", F.col("l_extendedprice") * (1 - F.col("l_discount") * F.col("k")))
    return priced.groupBy("l_returnflag").pivot("model", ["m0", "m1", "m2", "m3"]).agg(F.round(F.avg("v"), 6))


def ablation_deltas(spark, sf_dir):
    means = read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return E.deltas(means, "event_type", "mean", "view")


def parse_numbers(spark, sf_dir):
    """The five parsers over prices, sizes and names dressed as texts."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    k = F.pmod("p_partkey", F.lit(6))
    money = F.format_string("%.2f", "p_retailprice")
    text = (
        F.when(k == 0, F.concat(F.lit("$"), money)).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit("K"))).when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit("%")))
        .when(k == 3, F.concat(F.lit(" 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" "))).when(k == 4, F.col("p_name")).otherwise(F.concat(F.lit("1O"), F.col("p_size").cast("string"), F.lit("m")))
    )
    t = p.withColumn("t", text)
    c = F.col("t")
    return t.select("p_partkey", N.parse_mapper(c).alias("mapper"), N.parse_metric(c).alias("metric"), N.parse_demo(c).alias("demo"), F.size(N.all_numbers(c)).alias("numbers"), N.is_number(c).alias("is_number"))


def numeric_match(spark, sf_dir):
    """Lines whose price is within five percent of the part's list price times the quantity."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(N.relative_match(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")).alias("matched")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (text_metrics, bleu1, fuzzy_match, latency_nearest_rank, error_rate_by_type, worst20, confusion_matrix, prf1, class_weights, type_distribution_sets, cross_models_metrics_pivot, ablation_deltas, parse_numbers, numeric_match)}

_TRIM = r"regexp_replace(lower({}), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_WHOLE = rf"""{QA_SQL}, s AS (SELECT conv_id, qa_idx, nfc_normalize(answer) AS a, nfc_normalize(question) AS q FROM qa),
n AS (SELECT *, regexp_replace({_TRIM.format('a')}, '[\s\x0B]+', ' ', 'g') AS p, regexp_replace({_TRIM.format('q')}, '[\s\x0B]+', ' ', 'g') AS t FROM s)"""
#: DuckDB's levenshtein counts bytes: letters of Latin-1, lower-cased, stand as bytes that lower-cased texts don't have, so that it counts characters.
_BYTES = "translate({}, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6))"
_PRED = "p AS (SELECT doc_id, quality, CAST(n_chars >= 400 AS INT) AS pred FROM labels JOIN documents USING (doc_id))"
ORACLES = {
    "text_metrics": f"""WITH {_WHOLE}, m AS (SELECT *, levenshtein({_BYTES.format('p')}, {_BYTES.format('t')})::DOUBLE AS d, regexp_extract_all(lower(a), '-?\\d+(?:\\.\\d+)?(?:e[+-]?\\d+)?') AS na, regexp_extract_all(lower(q), '-?\\d+(?:\\.\\d+)?(?:e[+-]?\\d+)?') AS nq FROM n)
      SELECT conv_id, qa_idx, p = t AS exact, contains(p, t) AS contains,
        round(CASE WHEN t = '' THEN CASE WHEN p = '' THEN 1.0::DOUBLE ELSE 0 END WHEN d / greatest(length(p), length(t)) > 0.5 THEN 0 ELSE 1 - d / greatest(length(p), length(t)) END, 6) AS anls,
        round(CASE WHEN t = '' THEN CASE WHEN p = '' THEN 0.0::DOUBLE ELSE 1 END ELSE d / length(t) END, 6) AS cer,
        round(CASE WHEN len(nq) = 0 THEN -1.0::DOUBLE WHEN len(na) = 0 THEN 0 ELSE len(list_filter(nq, lambda x: len(list_filter(na, lambda y: CASE WHEN abs(x::DOUBLE) < 1e-9 THEN abs(y::DOUBLE) < 1e-9 ELSE abs(y::DOUBLE - x::DOUBLE) / (abs(x::DOUBLE) + 1e-9) <= 0.05 END)) > 0))::DOUBLE / len(nq) END, 6) AS numeric,
        CASE WHEN length({_TRIM.format('q')}) <= 5 THEN 'short' WHEN length({_TRIM.format('q')}) <= 50 THEN 'medium' ELSE 'long' END AS length FROM m""",
    "bleu1": f"""WITH {_WHOLE}, b AS (SELECT conv_id, qa_idx, list_filter(string_split(regexp_replace(p, '\\.+$', ''), ' '), lambda x: x <> '') AS a, list_filter(string_split(regexp_replace(t, '\\.+$', ''), ' '), lambda x: x <> '') AS r FROM n),
      c AS (SELECT conv_id, qa_idx, a, r, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))) AS k FROM b)
      SELECT conv_id, qa_idx, round(CASE WHEN len(a) = 0 OR len(r) = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN len(a) < len(r) THEN exp(1 - len(r)::DOUBLE / len(a)) ELSE 1.0 END) * k / len(a) END, 6) AS bleu_1 FROM c""",
    "fuzzy_match": f"""WITH {_WHOLE}, f AS (SELECT conv_id, qa_idx, {_TRIM.format('q')} AS g, {_TRIM.format('a')} AS b FROM s), k AS (SELECT *, regexp_replace(g, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS gk, regexp_replace(b, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS bk FROM f)
      SELECT conv_id, qa_idx, CASE WHEN g = '' OR b = '' THEN false ELSE contains(g, b) OR contains(b, g) OR (gk <> '' AND bk <> '' AND (contains(gk, bk) OR contains(bk, gk)))
        OR (length(gk) >= 3 AND len(list_filter(string_split(gk, ''), lambda c: contains(bk, c)))::DOUBLE / length(gk) >= 0.6) END AS matched FROM k""",
    "latency_nearest_rank": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS INT) + 1] AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
    "error_rate_by_type": "SELECT event_type, count(*) AS total, count(*) FILTER (value < 10) AS errors, round(avg(CAST(value < 10 AS INT)), 6) AS rate, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1",
    "worst20": "SELECT event_id, event_type, value FROM events ORDER BY value, event_id LIMIT 20",
    "confusion_matrix": f"WITH {_PRED} SELECT quality AS gt, pred, count(*) AS n FROM p GROUP BY ALL",
    "prf1": f"""WITH {_PRED}, c AS (SELECT cls, (SELECT count(*) FROM p WHERE quality = cls) AS support, (SELECT count(*) FROM p WHERE pred = cls) AS predicted, (SELECT count(*) FROM p WHERE pred = cls AND quality = cls) AS tp FROM (SELECT quality AS cls FROM p UNION SELECT pred FROM p)),
      d AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS a, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS b FROM c)
      SELECT cls, support, predicted, tp, round(a, 6) AS precision, round(b, 6) AS recall, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS f1 FROM d""",
    "class_weights": "SELECT label, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY 1",
    "type_distribution_sets": """SELECT CASE WHEN o_orderstatus IS NOT NULL THEN 'o_orderstatus' WHEN o_orderpriority IS NOT NULL THEN 'o_orderpriority' ELSE 'c_mktsegment' END AS dimension, coalesce(o_orderstatus, o_orderpriority, c_mktsegment) AS value, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (c_mktsegment))""",
    "cross_models_metrics_pivot": "SELECT l_returnflag, " + ", ".join(f"round(avg(l_extendedprice * (1 - l_discount * {k}::DOUBLE)), 6) AS m{i}" for i, k in enumerate(("0.0", "0.5", "1.0", "2.0"))) + " FROM lineitem GROUP BY 1",
    "ablation_deltas": """WITH m AS (SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1), b AS (SELECT mean AS base FROM m WHERE event_type = 'view')
      SELECT event_type, mean, round(mean - base, 6) AS delta, round((mean - base) / abs(base), 6) AS relative, CASE WHEN abs((mean - base) / abs(base)) < 0.01 THEN 'same' WHEN mean > base THEN 'higher' ELSE 'lower' END AS band FROM m, b""",
    "parse_numbers": r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) WHEN 1 THEN p_size || 'K' WHEN 2 THEN p_size || '%' WHEN 3 THEN ' 1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' ' WHEN 4 THEN p_name ELSE '1O' || p_size || 'm' END AS t FROM part),
      c AS (SELECT p_partkey, t, trim(t) AS s, translate(trim(t), ',%', '') AS m, regexp_replace(regexp_replace(trim(t), '^[$]+', ''), '%$', '') AS d FROM t),
      v AS (SELECT *, replace(translate(regexp_replace(s, '[%kKmMbB]$', ''), 'OlI', '011'), ',', '') AS b1, regexp_replace(m, '[kKmMbB]$', '') AS b2, replace(regexp_replace(d, '[kKmMbB]$', ''), ',', '') AS b3 FROM c)
      SELECT p_partkey, CASE WHEN regexp_matches(b1, '^[+-]?(\d+(\.\d*)?|\.\d+)$') THEN b1::DOUBLE END * CASE lower(right(s, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS mapper,
        CASE WHEN regexp_matches(b2, '^[+-]?(\d+(\.\d*)?|\.\d+)$') THEN b2::DOUBLE END * CASE lower(right(m, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS metric,
        CASE WHEN regexp_matches(b3, '^[+-]?(\d+(\.\d*)?|\.\d+)$') THEN b3::DOUBLE END * CASE lower(right(d, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS demo,
        len(regexp_extract_all(lower(t), '-?\d+(?:\.\d+)?(?:e[+-]?\d+)?')) AS numbers, regexp_matches(translate(s, ',%$', ''), '^[+-]?(\d+(\.\d*)?|\.\d+)$') AS is_number FROM v""",
    "numeric_match": "SELECT CASE WHEN l_quantity * p_retailprice = 0 THEN abs(l_extendedprice) < 1e-9 ELSE abs(l_extendedprice - l_quantity * p_retailprice) <= 0.05::DOUBLE * abs(l_quantity * p_retailprice) END AS matched, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
}
