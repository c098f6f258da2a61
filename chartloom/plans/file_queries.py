"""Queries through file sources, sinks and plug-ins. Each has executors write files made of the documents to the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import stages as G
from chartloom.sources import chart_tables as C
from chartloom.sources import files, sinks
from chartloom.sources.tables import read

KINDS = ("bar", "line", "pie", "unknown")


def _items(spark, sf_dir):
    """(k, name, region, text): documents by their id; names are upper case and differ."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    text = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return d.select(F.col("doc_id").alias("k"), F.upper(F.concat(text("source"), F.lit(" "), text("lang"), F.lit(" D"), F.col("doc_id").cast("string"))).alias("name"), (F.col("doc_id") % 5).alias("region"), "text")


#: Folders that a tree's documents are dealt over, so that none holds too many files.
SHELVES = 256


def _shelf(k):
    return F.concat(F.lit("s"), (k % SHELVES).cast("string"), F.lit("/"))


def _tree(spark, sf_dir, *parts) -> str:
    """A glob of folders of documents' files: JSON by chart type with the whole text (one in seven broken), images (one in five none), Markdown, and other files. parts: those that a query reads."""
    i = _items(spark, sf_dir)
    k, n, region = F.col("k"), F.concat(F.lit("n"), F.col("k").cast("string")), F.col("region").cast("string")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), k % 4), lambda x: x < k % 4), lambda x: F.struct(F.concat(F.lit("q"), x.cast("string")).alias("q")))
    record = F.when(k % 7 == 6, "{broken").otherwise(F.to_json(F.struct("name", pairs.alias("pairs"), "text")))
    second = F.when(k % 3 == 0, F.concat(F.lit('{"name": "'), F.lower("name"), F.lit('", "pairs": []}')))
    size = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(k * 10 + 1), 8, "0")), F.unhex(F.lit("00000032")), F.unhex(F.lit("0802000000")))
    picture = F.when(k % 5 == 4, F.lit("no image").cast("binary")).otherwise(size)
    page = F.when(k % 2 == 1, F.concat(F.lit("# "), F.col("name"), F.lit("\n\ntext ![a](img/r"), region, F.lit("/"), n, F.lit(".png) ![b](http://x/y.png)"))).otherwise(F.col("name"))
    file = lambda path, content: F.struct(F.concat(*path).alias("path"), content.cast("binary").alias("content"))
    made = F.array(
        file((F.lit("qa/"), C.pick(k, KINDS), F.lit("/"), n, F.lit(".json")), record),
        file((F.lit("qa/"), C.pick(k + 1, KINDS[:3]), F.lit("/"), n, F.lit(".json")), second),
        file((F.lit("img/r"), region, F.lit("/"), n, F.when(k % 2 == 1, ".png").otherwise(".PNG")), picture),
        file((F.lit("doc/"), n, F.lit("."), C.pick(k, ("md", "pdf", "txt", "docx", "jpeg"))), page),
    )
    # where both records have one path, the second stays
    same = (k % 3 == 0) & (C.pick(k, KINDS) == C.pick(k + 1, KINDS[:3]))
    kept = F.filter(made, lambda f: f["content"].isNotNull())
    rows = i.select(_shelf(k).alias("shelf"), F.explode(F.when(same, F.slice(kept, 2, 9)).otherwise(kept)).alias("f")).select(F.concat("shelf", "f.path").alias("path"), "f.content")
    if parts:
        rows = rows.where(F.split("path", "/")[1].isin(*parts))
    sinks.write_files(rows, folder := files.shared_folder(spark))
    return f"{folder}/*"


def file_records(spark, sf_dir):
    r = files.records(spark, f"{_tree(spark, sf_dir, 'qa')}/qa/*/*.json", "name string, pairs array<struct<q:string>>")
    return r.select("chart_type", "chart_id", "name", F.size("pairs").alias("pairs"))


def merged_dataset(spark, sf_dir):
    r = files.records(spark, f"{_tree(spark, sf_dir, 'qa')}/qa/*/*.json", "name string, pairs array<struct<q:string>>")
    return sinks.merged_dataset(r.withColumn("n", F.size("pairs")), "n")


def file_inventory(spark, sf_dir):
    return files.inventory(spark, _tree(spark, sf_dir), depth=2)


def file_dispatch(spark, sf_dir):
    d = files.dispatched(files.listed(spark, f"{_tree(spark, sf_dir, 'doc')}/doc"), most_bytes=60)
    return d.groupBy("parser", "error").agg(F.count("*").alias("n"))


def file_uploads(spark, sf_dir):
    """What becomes of the documents' files when they are taken over, and what is there afterwards."""
    target = files.shared_folder(spark)
    said = sinks.uploads(spark, f"{_tree(spark, sf_dir, 'doc')}/doc", target, 60)
    there = files.listed(spark, target).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("saved"), "length")
    j = said.join(there, "saved", "left").withColumn("kind", files.extension(F.col("path")))
    return j.groupBy("status", "kind").agg(F.count("*").alias("n"), F.count("length").alias("copied"), F.sum("length").alias("bytes"))


def file_images(spark, sf_dir):
    return files.images(spark, f"{_tree(spark, sf_dir, 'img')}/img").select(files.path_parts(F.col("path"))[1].alias("image"), "width", "height")


def markdown_scan(spark, sf_dir):
    """Local pictures of Markdown files that are there and are images; a file without any has one row."""
    folder = _tree(spark, sf_dir, "doc", "img")
    md = files.contents(files.listed(spark, f"{folder}/doc").where("path LIKE '%.md'"))
    docs = md.select(files.path_parts(F.col("path"))[1].alias("doc"), F.col("content").cast("string").alias("text"))
    refs = files.markdown_images(docs, "doc", "text").withColumn("stem", files.path_parts(F.concat(F.lit("/"), F.col("image")))[1])
    there = files.images(spark, f"{folder}/img").select(files.path_parts(F.col("path"))[1].alias("stem"), "width", F.lit(1).alias("there"))
    return refs.join(there, "stem", "left").groupBy("doc").agg(F.count("there").alias("pictures"), F.min("width").alias("width"))


def manifest_ids(spark, sf_dir):
    """A benchmark with a manifest, and one that only has annotations."""
    a, b = files.shared_folder(spark), files.shared_folder(spark)
    i = _items(spark, sf_dir)
    named = i.agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("x")).select(F.lit("manifest.json").alias("path"), F.to_json(F.struct(F.col("x.name").alias("chart_ids"))).alias("content"))
    sinks.write_files(named.union(spark.createDataFrame([("annotations/other.json", "{}")], "path string, content string")), a)
    sinks.write_files(i.select(F.concat(F.lit("annotations/"), F.replace("name", F.lit(" "), F.lit("_")), F.lit(".json")).alias("path"), F.lit("{}").alias("content")), b)
    one, two = files.manifest_ids(spark, a, 10), files.manifest_ids(spark, b, 10)
    return one.withColumn("benchmark", F.lit("manifest")).unionByName(two.withColumn("benchmark", F.lit("annotations")))


def found_files(spark, sf_dir):
    """Each document's QA file: in the folder of its type first, else in any."""
    ids = _items(spark, sf_dir).select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("chart_id"), C.pick(F.col("k") + 1, KINDS[:3]).alias("kind"))
    f = files.found_files(ids, files.listed(spark, f"{_tree(spark, sf_dir, 'qa')}/qa"), "chart_id", (".json",), "kind")
    return f.select("chart_id", "kind", files.path_parts(F.col("path"))[0].alias("folder"))


def class_folders(spark, sf_dir):
    c = files.class_folders(files.listed(spark, f"{_tree(spark, sf_dir, 'img')}/img"), "r0")
    return c.groupBy("cls", "positive").agg(F.count("*").alias("n"))


def cached_results(spark, sf_dir):
    """Paths with a cached result, one under the other separator, cached errors, and misses."""
    n = _items(spark, sf_dir).select("k", F.concat(F.lit("a/n"), F.col("k").cast("string")).alias("path"))
    cache = n.where("k % 3 <> 0").select(F.when(F.col("k") % 2 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path")).alias("path"), F.lit("hit").alias("result"), F.when(F.col("k") % 5 == 0, "failed").alias("error"))
    return files.with_cache(n, cache, F.lit("computed")).select("k", "result")


def run_scan(spark, sf_dir):
    """Results of all runs, broken files skipped."""
    folder = files.shared_folder(spark)
    k = F.col("k")
    content = F.when(k % 6 == 5, "[1").otherwise(F.to_json(F.struct((k / 4).alias("score"), F.col("name").alias("model"))))
    sinks.write_files(_items(spark, sf_dir).select(F.concat(_shelf(k), F.lit("run"), k.cast("string"), F.lit("/results.json")).alias("path"), content.alias("content")), folder)
    return files.records(spark, f"{folder}/*/*/results.json", "score double, model string", typed=False).select(F.col("chart_type").alias("run"), "score", "model")


def conversation_loader(spark, sf_dir):
    """Rows with conversations, with messages, with both and with neither."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    none = F.lit(None).cast(c.schema["t"].dataType)
    k = F.col("conv_id") % 4
    rows = c.select("conv_id", F.when(k < 2, F.col("t")).otherwise(none).alias("conversations"), F.when((k == 1) | (k == 2), F.slice("t", 1, 1)).otherwise(none).alias("messages"))
    return files.conversation_rows(rows, "conv_id").select("conv_id", F.size("turns").alias("turns"))


def fan_out(spark, sf_dir):
    """Documents as JSON, CSV and text, one form skipped and one failing; what each sink holds."""
    folder = files.shared_folder(spark)
    n = _items(spark, sf_dir)
    lines = n.select(F.concat_ws(" ", F.col("k").cast("string"), "name").alias("line"))
    said = sinks.fan_out({"json": (n, sinks.as_json), "csv": (n, sinks.as_csv), "text": (lines, sinks.as_text("line")), "markdown": None, "broken": (n, sinks.as_text("k"))}, folder)
    rows = {"json": spark.read.json(f"{folder}/json"), "csv": spark.read.option("header", True).option("multiLine", True).csv(f"{folder}/csv"), "text": spark.read.text(f"{folder}/text")}
    counts = None
    for name, state in said.items():
        of = rows[name].agg(F.count("*").alias("n")) if name in rows else spark.range(1).select(F.lit(0).cast("long").alias("n"))
        one = of.select(F.lit(name).alias("sink"), F.lit(state.split(":")[0]).alias("state"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def text_each(spark, sf_dir):
    """One JSON text a region and document, read back with both from its path."""
    folder = f"{files.shared_folder(spark)}/each"
    n = _items(spark, sf_dir).select(F.concat(F.lit("r"), F.col("region").cast("string")).alias("chart_type"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("chart_id"), F.to_json(F.struct("name", "text")).alias("text"))
    sinks.text_each(n, folder, "chart_type", "chart_id", "text")
    return sinks.texts_of(spark, folder, "chart_type", "chart_id").select("chart_type", "chart_id", F.from_json("value", "name string")["name"].alias("name"))


def metric_log(spark, sf_dir):
    """A log of metrics written in two steps."""
    path = f"{files.shared_folder(spark)}/log"
    e = _items(spark, sf_dir).select(F.col("region").alias("run_id"), F.col("k").alias("step"), (F.col("k") / 8).alias("loss"))
    for part in (0, 1):
        sinks.append_metrics(e.where(F.col("step") % 2 == part), path)
    return spark.read.json(path).groupBy("run_id").agg(F.count("*").alias("steps"), F.max_by("loss", "step").alias("last"))


def mock_detections(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 20).alias("width").cast("long"), F.lit(300).cast("long").alias("height"))
    return G.REGISTRY.resolve("detection", "MOCK")()(p)


def routed_engines(spark, sf_dir):
    r = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), C.pick(F.col("p_partkey"), ("describe", "count", "other")).alias("task"), F.col("p_name").alias("prompt"))
    return G.routed(r, ["rules", "echo"])


QUERIES = {f.__name__: f for f in (file_records, merged_dataset, file_inventory, file_dispatch, file_uploads, file_images, markdown_scan, manifest_ids, found_files, class_folders, cached_results, run_scan, conversation_loader, fan_out, text_each, metric_log, mock_detections, routed_engines)}

_REC = """rec AS (SELECT CASE WHEN k % 3 = 0 AND NOT first THEN ['bar', 'line', 'pie'][(k + 1) % 3 + 1] ELSE ['bar', 'line', 'pie', 'unknown'][k % 4 + 1] END AS chart_type, k, CASE WHEN first THEN name ELSE lower(name) END AS name, CASE WHEN first THEN k % 4 ELSE 0 END AS pairs, first AND k % 7 = 6 AS broken
    FROM (SELECT k, name, first FROM items, (VALUES (true), (false)) v(first) WHERE first OR k % 3 = 0)),
  same AS (SELECT k FROM rec GROUP BY k, chart_type HAVING count(*) > 1), one AS (SELECT * FROM rec r WHERE NOT (EXISTS (SELECT 1 FROM same s WHERE s.k = r.k) AND pairs = k % 4 AND name = upper(name) AND name <> lower(name) AND (SELECT count(*) FROM rec q WHERE q.k = r.k AND q.chart_type = r.chart_type) > 1)),
  good AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY chart_type DESC) AS p FROM one WHERE NOT broken AND chart_type <> 'unknown')"""
ORACLES = {
    "file_records": f"WITH {_REC} SELECT chart_type, 'n' || k AS chart_id, name, CAST(pairs AS INT) AS pairs FROM good WHERE p = 1",
    "merged_dataset": f"WITH {_REC}, b AS (SELECT chart_type, count(*) AS f, sum(pairs) AS e FROM good WHERE p = 1 GROUP BY 1) SELECT CAST(sum(f) AS BIGINT) AS files, CAST(sum(e) AS BIGINT) AS entries, '{{' || string_agg('\"' || chart_type || '\":' || e::BIGINT, ',' ORDER BY chart_type) || '}}' AS by_type FROM b",
    "file_images": "SELECT 'n' || k AS image, CAST(k * 10 + 1 AS INT) AS width, 50 AS height FROM items WHERE k % 5 <> 4",
    "file_dispatch": """WITH f AS (SELECT ['md', 'pdf', 'txt', 'docx', 'jpeg'][CAST(k % 5 + 1 AS INT)] AS e, CASE WHEN k % 2 = 1 THEN strlen('# ' || name || chr(10) || chr(10) || 'text ![a](img/r' || region || '/n' || k || '.png) ![b](http://x/y.png)') ELSE strlen(name) END AS b FROM items)
      SELECT CASE e WHEN 'md' THEN 'markdown' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'jpeg' THEN 'image' END AS parser, CASE WHEN e = 'txt' THEN 'unsupported extension .txt' WHEN b > 60 THEN 'too large' END AS error, count(*) AS n FROM f GROUP BY ALL""",
    "file_uploads": """WITH f AS (SELECT ['md', 'pdf', 'txt', 'docx', 'jpeg'][CAST(k % 5 + 1 AS INT)] AS e, CASE WHEN k % 2 = 1 THEN strlen('# ' || name || chr(10) || chr(10) || 'text ![a](img/r' || region || '/n' || k || '.png) ![b](http://x/y.png)') ELSE strlen(name) END AS b FROM items)
      SELECT CASE WHEN e = 'txt' THEN 400 WHEN b > 60 THEN 413 ELSE 200 END AS status, '.' || e AS kind, count(*) AS n, count(*) FILTER (e <> 'txt' AND b <= 60) AS copied, CAST(sum(b) FILTER (e <> 'txt' AND b <= 60) AS BIGINT) AS bytes FROM f GROUP BY ALL""",
    "markdown_scan": "SELECT 'n' || k AS doc, CASE WHEN k % 2 = 1 AND k % 5 <> 4 THEN 1 ELSE 0 END AS pictures, CASE WHEN k % 2 = 1 AND k % 5 <> 4 THEN CAST(k * 10 + 1 AS INT) END AS width FROM items WHERE k % 5 = 0",
    "manifest_ids": "WITH n AS (SELECT name, row_number() OVER (ORDER BY k) - 1 AS a, row_number() OVER (ORDER BY replace(name, ' ', '_')) - 1 AS b FROM items) SELECT CAST(a AS INT) AS pos, name AS chart_id, 'manifest' AS benchmark FROM n WHERE a < 10 UNION ALL SELECT CAST(b AS INT), replace(name, ' ', '_'), 'annotations' FROM n WHERE b < 10",
    "found_files": "WITH n AS (SELECT 'n' || k AS chart_id, ['bar', 'line', 'pie'][CAST((k + 1) % 3 + 1 AS INT)] AS kind, ['bar', 'line', 'pie', 'unknown'][CAST(k % 4 + 1 AS INT)] AS own, k % 3 = 0 AS two FROM items) SELECT chart_id, kind, CASE WHEN own = kind OR two THEN kind ELSE own END AS folder FROM n",
    "class_folders": "SELECT 'r' || region AS cls, region <> 0 AS positive, count(*) AS n FROM items GROUP BY ALL",
    "cached_results": "SELECT k, CASE WHEN k % 3 = 0 THEN 'computed' WHEN k % 5 = 0 THEN '' ELSE 'hit' END AS result FROM items",
    "run_scan": "SELECT 'run' || k AS run, k::DOUBLE / 4 AS score, name AS model FROM items WHERE k % 6 <> 5",
    "conversation_loader": "SELECT conv_id, CAST(CASE WHEN conv_id % 4 < 2 THEN count(*) ELSE 1 END AS INT) AS turns FROM conversations WHERE conv_id % 4 < 3 GROUP BY conv_id",
    "fan_out": "SELECT s AS sink, CASE s WHEN 'markdown' THEN 'skipped' WHEN 'broken' THEN 'failed' ELSE 'written' END AS state, CASE WHEN s IN ('json', 'csv', 'text') THEN (SELECT count(*) FROM items) ELSE 0 END AS n FROM (VALUES ('json'), ('csv'), ('text'), ('markdown'), ('broken')) v(s)",
    "text_each": "SELECT 'r' || region AS chart_type, 'n' || k AS chart_id, name AS name FROM items",
    "metric_log": "SELECT region AS run_id, count(*) AS steps, arg_max(k / 8, k) AS last FROM items GROUP BY 1",
    "mock_detections": """WITH i AS (SELECT p_partkey AS image_id, p_size * 20 AS w, 300 AS h, k FROM part, range(2) r(k) WHERE p_partkey % 9 <> 0), b AS (SELECT image_id, k, w, h, (image_id * 7 + k * 13) % w AS x0, (image_id * 11 + k * 17) % h AS y0 FROM i)
      SELECT image_id, CAST(k AS INT) AS box, x0, y0, least(w, x0 + 100) AS x1, least(h, y0 + 80) AS y1, round(0.9::DOUBLE - 0.1::DOUBLE * k, 6) AS confidence FROM b UNION ALL SELECT p_partkey, -1, NULL, NULL, NULL, NULL, 0.0 FROM part WHERE p_partkey % 9 = 0""",
    "routed_engines": "SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 2 THEN 'echo' ELSE 'rules' END AS engine, CASE p_partkey % 3 WHEN 0 THEN 'A chart: ' || p_name WHEN 1 THEN length(p_name)::VARCHAR ELSE p_name END AS answer, CASE p_partkey % 3 WHEN 2 THEN 0.5::DOUBLE ELSE 0.8 END AS confidence FROM part",
}
_ITEMS = "items AS (SELECT doc_id AS k, upper(coalesce(source, 'none') || ' ' || coalesce(lang, 'none') || ' D' || doc_id) AS name, doc_id % 5 AS region FROM documents WHERE doc_id IS NOT NULL)"
ORACLES = {k: q if "items" not in q else q.replace("WITH ", f"WITH {_ITEMS}, ", 1) if q.startswith("WITH ") else f"WITH {_ITEMS} {q}" for k, q in ORACLES.items()}
