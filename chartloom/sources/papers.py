"""Papers out of XML: journal articles with their figures, and search feeds, by declared schemas.

XML that can't be read is kept as a row with its text in `corrupt` and nothing else: callers see what was lost. Files are split
at the end of each record by Spark's text reader, so that a large file is read by many tasks; then records are parsed like texts in a column
(`from_xml`). Fields that hold markup come as inner XML with references resolved, where a resolved `<` would look like a tag; so
XML's five named references are escaped once more before parsing, and resolved by plain() after tags are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_FIGURE = "struct<_id:string,label:string,caption:string,graphic:array<struct<`_xlink:href`:string,_href:string>>>"
_SECTION = f"struct<title:string,p:array<string>,fig:array<{_FIGURE}>,`fig-group`:array<struct<fig:array<{_FIGURE}>>>"
#: An article; sections nest two deep.
ARTICLE = (
    "front struct<`article-meta`:struct<`article-id`:array<struct<_VALUE:string,`_pub-id-type`:string>>,`title-group`:struct<`article-title`:string>,"
    "`pub-date`:array<struct<day:string,month:string,year:string>>,abstract:array<string>>>,"
    f"body struct<p:array<string>,fig:array<{_FIGURE}>,sec:array<{_SECTION},sec:array<{_SECTION}>>>>>,corrupt string"
)
#: A feed of search results.
FEED = "title string,entry array<struct<id:string,title:string,published:string,summary:string,link:array<struct<_href:string,_title:string>>>>,corrupt string"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "attributePrefix": "_", "valueTag": "_VALUE"}
#: Parts of a date that a paper leaves out.
YEAR, FIRST = "2020", "01"
ABSTRACT = 500


def resolved(c: Column) -> Column:
    """Text with the references resolved that parsed() has left."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain(c: Column) -> Column:
    """The text of inner XML, without outer white space."""
    return F.regexp_replace(resolved(F.regexp_replace(c, "<[^>]*>", "")), r"^\s+|\s+$", "")


def records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(xml): the elements of a tag in XML files, each cut out as text; what stands between them goes."""
    ended = spark.read.option("lineSep", f"</{tag}>").text(path)
    begun = F.regexp_extract("value", rf"(?s)<{tag}[\s>].*$", 0)
    return ended.select(F.concat(begun, F.lit(f"</{tag}>")).alias("xml")).where(begun != "")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles of XML files, as rows for articles()."""
    return parsed(records(spark, path, "article"), "xml", ARTICLE).select("x.*")


def parsed(texts: DataFrame, xml: str, schema: str) -> DataFrame:
    """texts with the struct `x` that their XML holds by a schema."""
    kept = F.regexp_replace(F.col(xml), "&(lt|gt|amp|quot|apos);", "&amp;$1;")
    return texts.withColumn("x", F.from_xml(kept, schema, OPTIONS))


def articles(found: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, pmc_id, title, abstract, published_date, figures) of rows with `front` and `body`; rows without a PMC id, corrupt ones among them, go.

    Of several dates the first counts; parts that are missing are those of 2020-01-01. The abstract keeps ABSTRACT characters. Figures
    without a graphic are none.
    """
    meta = F.col("front.article-meta")
    pmc = F.get(F.filter(meta["article-id"], lambda i: i["_pub-id-type"] == "pmc"), F.lit(0))["_VALUE"]
    date = F.get(meta["pub-date"], F.lit(0))
    part = lambda name: F.lpad(F.coalesce(date[name], F.lit(FIRST)), 2, "0")
    none = F.array().cast(f"array<{_FIGURE}>")
    of = lambda s: F.concat(F.coalesce(s["fig"], none), F.coalesce(F.flatten(s["fig-group"]["fig"]), none))
    deep = F.flatten(F.transform(F.coalesce(F.col("body.sec"), F.array().cast(f"array<{_SECTION},sec:array<{_SECTION}>>>>")), lambda s: F.concat(of(s), F.flatten(F.transform(F.coalesce(s["sec"], F.array().cast(f"array<{_SECTION}>>")), of)))))
    href = lambda f: F.coalesce(F.get(f["graphic"], F.lit(0))["_xlink:href"], F.get(f["graphic"], F.lit(0))["_href"])
    figures = F.filter(F.concat(F.coalesce(F.col("body.fig"), none), deep), lambda f: F.coalesce(href(f), F.lit("")) != "")
    shown = F.transform(figures, lambda f: F.struct(F.coalesce(resolved(f["_id"]), F.lit("")).alias("fig_id"), F.coalesce(plain(f["label"]), F.lit("")).alias("label"), F.coalesce(plain(f["caption"]), F.lit("")).alias("caption"), resolved(href(f)).alias("graphic_href")))
    return found.where(pmc.isNotNull()).select(
        *keep,
        pmc.alias("pmc_id"),
        F.coalesce(plain(meta["title-group"]["article-title"]), F.lit("Unknown")).alias("title"),
        F.substring(F.coalesce(plain(F.get(meta["abstract"], F.lit(0))), F.lit("")), 1, ABSTRACT).alias("abstract"),
        F.concat_ws("-", F.coalesce(date["year"], F.lit(YEAR)), part("month"), part("day")).alias("published_date"),
        shown.alias("figures"),
    )


def article_figures(found: DataFrame) -> DataFrame:
    """(pmc_id, place, fig_id, label, caption, graphic_href): a row for each figure of articles()."""
    return found.select("pmc_id", F.posexplode("figures").alias("place", "f")).select("pmc_id", "place", "f.*")


def feed_papers(found: DataFrame, order: str, seeds: list[str], limit: int | None = None) -> DataFrame:
    """(arxiv_id, title, published_date, pdf_url): papers of feeds that have a PDF; seeds first, then by feed and place, each id once, `limit` at most.

    found: rows with `x`, as parsed() gives them, and a column that orders the feeds. An id is kept by its least place, so
    repeats meet before the shuffle; with a limit each task keeps its first ones.
    """
    e = found.select(order, F.posexplode("x.entry").alias("place", "e"))
    pdf = F.get(F.filter("e.link", lambda a: a["_title"] == "pdf"), F.lit(0))["_href"]
    pdf = resolved(pdf)
    one = e.select(F.element_at(F.split("e.id", "/"), -1).alias("arxiv_id"), plain(F.col("e.title")).alias("title"), F.to_timestamp("e.published").alias("published_date"), pdf.alias("pdf_url"), order, "place").where("pdf_url IS NOT NULL")
    at = F.struct((~F.col("arxiv_id").isin(seeds)).alias("later"), order, "place")
    first = one.groupBy("arxiv_id").agg(F.min_by(F.struct("title", "published_date", "pdf_url"), at).alias("x"), F.min(at).alias("at"))
    if limit is not None:
        first = first.orderBy("at").limit(limit)
    return first.select("arxiv_id", "x.*")
