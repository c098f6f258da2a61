"""Queries over XML, Word and streamed sources, made by executors from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.sources import papers as P
from chartloom.sources import word_files as W
from chartloom.sources.files import shared_folder
from chartloom.sources.tables import read
from chartloom.streaming import jobs, progress, pulled


def _escaped(c):
    """Text that XML can hold: characters that it forbids go, its own are escaped."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _article_texts(spark, sf_dir):
    """A document as a journal article: its lines are captions of its figures; some lack an id, a date or parts of it, some are cut off."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    figure = lambda x, i: F.concat(F.lit('<fig id="f'), i.cast("string"), F.lit('"><label>Figure '), (i + 1).cast("string"), F.lit("</label><caption><p>"), _escaped(x), F.lit("</p></caption>"), F.when(i % 3 != 2, F.concat(F.lit('<graphic xlink:href="g'), i.cast("string"), F.lit('.jpg"/>'))).otherwise(""), F.lit("</fig>"))
    date = F.when(k % 5 == 0, "").when(k % 5 == 1, "<pub-date><year>2019</year></pub-date>").otherwise(F.concat(F.lit("<pub-date><day>"), (k % 28 + 1).cast("string"), F.lit("</day><month>"), (k % 12 + 1).cast("string"), F.lit("</month><year>2021</year></pub-date><pub-date><year>1999</year></pub-date>")))
    ids = F.concat(F.lit('<article-id pub-id-type="doi">10.1/'), n, F.lit("</article-id>"), F.when(k % 11 != 0, F.concat(F.lit('<article-id pub-id-type="pmc">PMC'), n, F.lit("</article-id>"))).otherwise(""))
    title = F.when(k % 4 != 0, F.concat(F.lit("<title-group><article-title>Paper <italic>"), n, F.lit("</italic> &amp; "), _escaped("source"), F.lit("</article-title></title-group>"))).otherwise("")
    body = F.concat(F.lit("<body><sec><title>One</title>"), F.array_join(F.transform(lines, figure), ""), F.lit("</sec></body>"))
    xml = F.concat(F.lit('<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta>'), ids, F.coalesce(title, F.lit("")), date, F.lit("<abstract><p>"), _escaped("text"), F.lit("</p></abstract></article-meta></front>"), body, F.lit("</article>"))
    return d.select("doc_id", F.when(k % 13 == 0, F.substring(xml, 1, 200)).otherwise(xml).alias("xml"))


def _articles(spark, sf_dir):
    return P.articles(P.parsed(_article_texts(spark, sf_dir), "xml", P.ARTICLE).select("doc_id", "x.*"), ["doc_id"])


def xml_articles(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return a.select("doc_id", "pmc_id", "title", F.md5(F.regexp_replace("abstract", r"\s+", "")).alias("abstract_md5"), "published_date", F.size("figures").alias("n_figures"))


def xml_figures(spark, sf_dir):
    f = P.article_figures(_articles(spark, sf_dir))
    return f.select("pmc_id", "place", "fig_id", "label", F.md5(F.regexp_replace("caption", r"\s+", "")).alias("caption_md5"), "graphic_href")


def feed_papers(spark, sf_dir):
    """Feeds of ten documents each; every third entry without a PDF, ids repeat in other feeds."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "source")
    both = d.withColumn("feed", F.floor(F.col("doc_id") / 10)).unionByName(d.where("doc_id % 7 = 0").withColumn("feed", F.floor(F.col("doc_id") / 10) + 3))
    n = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit('<link title="pdf" href="http://host/pdf/'), n, F.lit("-"), F.col("feed").cast("string"), F.lit('"/>'))).otherwise("")
    entry = F.concat(F.lit("<entry><id>http://host/abs/"), n, F.lit("v1</id><title> Paper "), n, F.lit(" of "), _escaped(F.coalesce("source", F.lit(""))), F.lit(" </title><published>2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit('T10:00:00Z</published><link href="http://host/abs"/>'), link, F.lit("</entry>"))
    feeds = both.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "").alias("all")).select("feed", F.concat(F.lit("<feed><title>q</title>"), "all", F.lit("</feed>")).alias("xml"))
    return P.feed_papers(P.parsed(feeds, "xml", P.FEED), "feed", ["14v1", "35v1"]).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd HH:mm"))


CAPTION = r"^(figure|fig\.?|chart|graph|table|plot|diagram)\s*\d"


def _word_files(spark, sf_dir):
    """A document as a Word file: its lines are paragraphs, an image stands behind every ninth line; every sixth has none, every seventh is no archive."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "source", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", ""), "\n").alias("lines"))
    texts = F.transform("lines", lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("Figure "), i.cast("string"), F.lit(": "), x)).otherwise(x))
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i % 9 == 4) & (F.col("doc_id") % 6 != 0))
    images = F.transform(places, lambda i: F.struct(i.alias("after"), F.concat(F.lit("image "), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string")).cast("binary").alias("bytes")))
    rows = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("title"), texts.alias("paragraphs"), images.alias("images"))
    made = W.files_of(rows)
    bad = F.substring_index("path", ".", 1).cast("long") % 7 == 0
    return made.select("path", F.when(bad, F.substring("content", 1, 50)).otherwise(F.col("content")).alias("content"))


def word_pages(spark, sf_dir):
    p = W.pages(W.bodies(_word_files(spark, sf_dir)), CAPTION)
    return p.select("path", "page", "title", F.md5("image").alias("image_md5"), F.md5("surrounding").alias("surrounding_md5"), F.md5("caption").alias("caption_md5"))


def word_errors(spark, sf_dir):
    return W.bodies(_word_files(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("files"), F.sum(F.size("paragraphs")).alias("paragraphs"), F.sum(F.size("images")).alias("images"))


def pulled_items(spark, sf_dir):
    """All documents with a text, pulled as a stream, two row groups a micro-batch."""
    pulled.register(spark)
    folder = shared_folder(spark)
    stream = spark.readStream.format("items").option("path", f"{sf_dir}/documents.parquet").option("columns", "doc_id,text").option("groups", "2").load()
    q = stream.select("doc_id", F.md5("text").alias("text_md5")).writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").start(f"{folder}/out")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("doc_id long, text_md5 string").parquet(f"{folder}/out")


def stream_metrics(spark, sf_dir):
    """Events as a stream of files; what its micro-batches observed, added up by type."""
    folder = shared_folder(spark)
    kinds = ("view", "click", "purchase", "scroll", "signup")
    events = jobs.event_stream(spark, f"{sf_dir}/events.parquet*")
    seen = progress.observed(events, "totals", F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0)).cast("decimal(38,6)")), 6).cast("string").alias("value"), *(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    log = progress.MetricLog(spark, f"{folder}/metrics", name := f"metrics_{folder[-12:]}")
    spark.streams.addListener(log)
    try:
        q = seen.groupBy("event_type").count().writeStream.format("noop").outputMode("complete").queryName(name).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        progress.drained(spark)
    finally:
        spark.streams.removeListener(log)
    m = progress.metric_rows(spark, f"{folder}/metrics").select("rows", F.from_json("metrics", "map<string,string>").alias("m"))
    of = lambda k: F.sum(F.col("m")[f"totals.{k}"].cast("decimal(38,6)"))
    return m.agg(F.sum("rows").alias("rows"), of("n").cast("long").alias("n"), of("value").cast("double").alias("value"), *(of(k).cast("long").alias(k) for k in kinds))


QUERIES = {f.__name__: f for f in (xml_articles, xml_figures, feed_papers, word_pages, word_errors, pulled_items, stream_metrics)}

_XML = r"""d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0), c AS (SELECT *, regexp_replace(text, '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS clean FROM d),
  l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM d)"""
_WORD = r"""d AS (SELECT doc_id, source, string_split(regexp_replace(coalesce(text, ''), '[\x01-\x08\x0B-\x1F]', '', 'g'), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
  t AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source END AS title, list_transform(lines, lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN 'Figure ' || (i - 1) || ': ' || x ELSE x END) AS texts FROM d),
  i AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN []::BIGINT[] ELSE list_filter(range(0, len(texts)), lambda i: i % 9 = 4) END AS images FROM t),
  p AS (SELECT *, flatten(list_transform(texts, lambda x, i: CASE WHEN (i - 1) % 9 = 4 AND doc_id % 6 <> 0 THEN [x, NULL] ELSE [x] END)) AS paras FROM i)"""
_CLEAN = r"regexp_replace(regexp_replace({}, '[\s\x0B]+', ' ', 'g'), '^ | $', '', 'g')"
_CUT = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) > 800 THEN left({0}, 800) || '...' ELSE {0} END"
_SOME = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '')"
ORACLES = {
    "pulled_items": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "stream_metrics": "SELECT count(*) AS rows, count(*) AS n, CAST(sum(CAST(coalesce(value, 0) AS DECIMAL(38, 6))) AS DOUBLE) AS value, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("view", "click", "purchase", "scroll", "signup")) + " FROM events",
    "word_pages": rf"""WITH {_WORD}, g AS (SELECT doc_id, title, paras, unnest(images) AS spot, generate_subscripts(images, 1) AS page FROM p WHERE doc_id % 7 <> 0),
      h AS (SELECT *, spot + page + 1 AS k FROM g), a AS (SELECT *, {_SOME.format('list_concat(paras[greatest(k - 3, 1):k - 1], paras[k + 1:k + 3])')} AS around FROM h),
      o AS (SELECT doc_id, title, page, 'image ' || doc_id || '/' || spot AS image, {_CLEAN.format("array_to_string(around, chr(10))")} AS s, list_filter(around, lambda x: regexp_matches(lower(x), '{CAPTION}'))[1] AS caption FROM a
        UNION ALL SELECT doc_id, title, 1, NULL, {_CLEAN.format("array_to_string(list_filter(paras, lambda x: regexp_replace(x, '^[ \t-]+', '') <> '' AND x IS NOT NULL), chr(10))")}, NULL FROM p WHERE len(images) = 0 AND doc_id % 7 <> 0)
      SELECT doc_id || '.docx' AS path, CAST(page AS INT) AS page, title, md5(image) AS image_md5, md5({_CUT.format('s')}) AS surrounding_md5, md5(caption) AS caption_md5 FROM o""",
    "word_errors": f"""WITH {_WORD} SELECT CASE WHEN doc_id % 7 = 0 THEN 'BadZipFile' END AS error, count(*) AS files, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE len(paras) END) AS BIGINT) AS paragraphs, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE len(images) END) AS BIGINT) AS images FROM p GROUP BY 1""",
    "xml_articles": rf"""WITH {_XML} SELECT doc_id, 'PMC' || doc_id AS pmc_id, CASE WHEN doc_id % 4 <> 0 AND source IS NOT NULL THEN 'Paper ' || doc_id || ' & ' || source ELSE 'Unknown' END AS title,
      md5(regexp_replace(left(regexp_replace(clean, '^[\s]+|[\s]+$', '', 'g'), 500), '[\s\x0B]+', '', 'g')) AS abstract_md5,
      CASE doc_id % 5 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2019-01-01' ELSE '2021-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS published_date,
      CAST(len(list_filter(lines, lambda x, i: i % 3 <> 0)) AS INT) AS n_figures FROM c JOIN l USING (doc_id)""",
    "xml_figures": rf"""WITH {_XML}, f AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM l)
      SELECT 'PMC' || doc_id AS pmc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS place, 'f' || (i - 1) AS fig_id, 'Figure ' || i AS label,
        md5(regexp_replace(regexp_replace(x, '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[\s\x0B]+', '', 'g')) AS caption_md5, 'g' || (i - 1) || '.jpg' AS graphic_href FROM f WHERE i % 3 <> 0""",
    "feed_papers": """WITH b AS (SELECT doc_id, source, doc_id // 10 AS feed FROM documents UNION ALL SELECT doc_id, source, doc_id // 10 + 3 FROM documents WHERE doc_id % 7 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY feed) AS k FROM b WHERE doc_id % 3 <> 0)
      SELECT doc_id || 'v1' AS arxiv_id, trim('Paper ' || doc_id || ' of ' || coalesce(source, '')) AS title, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 10:00' AS published_date, 'http://host/pdf/' || doc_id || '-' || feed AS pdf_url FROM r WHERE k = 1""",
}
