"""XML, Word and streamed sources against plain readers; streams against batches."""

from __future__ import annotations

import io
import json
import re
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chartloom.plans import source_queries
from chartloom.sources import papers, word_files
from chartloom.streaming import progress, pulled

SF = "/root/testdata/sf0.001"


def plain_article(text):
    """What a reader that walks the tree finds; None for bad XML or no id."""
    try:
        a = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    ids = [i.text for i in a.iter("article-id") if i.get("pub-id-type") == "pmc"]
    if not ids:
        return None
    whole = lambda e, other: "".join(e.itertext()).strip() if e is not None else other
    date = a.find(".//pub-date")
    part = lambda k, other: date.find(k).text if date is not None and date.find(k) is not None else other
    figures = []
    for f in a.iter("fig"):
        g = f.find(".//graphic")
        href = g.get("{http://www.w3.org/1999/xlink}href", "") if g is not None else ""
        if href:
            figures.append((f.get("id", ""), whole(f.find("label"), ""), whole(f.find("caption"), ""), href))
    return ids[0], whole(a.find(".//article-title"), "Unknown"), whole(a.find(".//abstract"), "")[:500], f"{part('year', '2020')}-{part('month', '01').zfill(2)}-{part('day', '01').zfill(2)}", figures


MADE = [
    '<article><front><article-meta><article-id pub-id-type="pmc">1</article-id></article-meta></front></article>',
    '<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="pmc">2</article-id><title-group><article-title>A <sub>b</sub> &lt;c&gt;</article-title></title-group><pub-date><year>2018</year><month>3</month></pub-date></article-meta></front>'
    '<body><fig id="x"><graphic xlink:href="top.jpg"/></fig><sec><fig-group><fig id="g"><label>1</label><caption><title>T</title><p>u</p></caption><graphic xlink:href="a.jpg"/></fig></fig-group><sec><fig id="deep"><graphic xlink:href="d.jpg"/></fig><fig id="none"/></sec></sec></body></article>',
    "<article><front>", "no xml", "", None, '<article><front><article-meta><article-id pub-id-type="doi">3</article-id></article-meta></front></article>',
]


def test_articles_are_those_of_a_tree_reader(spark):
    texts = [(r.doc_id, r.xml) for r in source_queries._article_texts(spark, SF).collect()] + [(-k, x) for k, x in enumerate(MADE, 1)]
    rows = papers.parsed(spark.createDataFrame(texts, "doc_id long, xml string"), "xml", papers.ARTICLE).select("doc_id", "x.*")
    squeezed = lambda t: re.sub(r"\s+", "", t)
    got = {r.doc_id: (r.pmc_id, r.title, squeezed(r.abstract), r.published_date, [(f.fig_id, f.label, squeezed(f.caption), f.graphic_href) for f in r.figures]) for r in papers.articles(rows, ["doc_id"]).collect()}
    want = {i: plain_article(x or "") for i, x in texts}
    want = {i: (w[0], w[1], squeezed(w[2]), w[3], [(*f[:2], squeezed(f[2]), f[3]) for f in w[4]]) for i, w in want.items() if w}
    assert set(got) == set(want)
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][3] == want[i][3] and sorted(got[i][4]) == sorted(want[i][4]), i
        assert got[i][2][:400] == want[i][2][:400], i  # where line ends count towards the 500 characters is the reader's
    assert {-3, -4} <= {r.doc_id for r in rows.where("corrupt IS NOT NULL").collect()}


def test_articles_are_read_from_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<set>{MADE[0]}{MADE[1]}</set>")
    (tmp_path / "b.xml").write_text(MADE[6])
    got = papers.articles(papers.read_articles(spark, str(tmp_path)), []).collect()
    assert sorted((r.pmc_id, r.title, len(r.figures)) for r in got) == [("1", "Unknown", 0), ("2", "A b <c>", 3)]


def test_feeds_keep_seeds_first_and_each_id_once(spark):
    entry = lambda i, pdf=True: f'<entry><id>http://x/abs/{i}</id><title>t{i}</title><published>2024-01-01T00:00:00Z</published><link href="u"/>' + (f'<link title="pdf" href="p{i}"/>' if pdf else "") + "</entry>"
    feeds = [(1, f"<feed>{entry(1)}{entry(2, False)}{entry(3)}</feed>"), (2, f"<feed>{entry(3)}{entry(4)}</feed>"), (3, "<feed><entry>"), (4, None), (5, "<feed></feed>")]
    found = papers.parsed(spark.createDataFrame(feeds, "k int, xml string"), "xml", papers.FEED)
    assert {r.arxiv_id: r.pdf_url for r in papers.feed_papers(found, "k", []).collect()} == {"1": "p1", "3": "p3", "4": "p4"}
    assert {r.arxiv_id for r in papers.feed_papers(found, "k", ["4"], limit=2).collect()} == {"4", "1"}


def test_word_files_on_disk(spark, tmp_path):
    texts = ["  First  line ", "", "Figure 2: a chart", "x" * 900, "after\tit"]
    made = {
        "a.docx": word_files.archive("A title", texts, [{"after": 1, "bytes": b"one"}, {"after": 4, "bytes": b"two"}]),
        "none.docx": word_files.archive(None, texts, []), "empty.docx": word_files.archive("t", [], []),
        "bad.docx": b"PK\x03\x04 no archive", "zero.docx": b"", "part.docx": word_files.archive("t", texts, [])[:-40], "other.txt": b"text",
    }
    out = io.BytesIO()
    import zipfile

    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<broken")
    made["xml.docx"] = out.getvalue()
    (tmp_path / "sub").mkdir()
    for k, (name, content) in enumerate(made.items()):
        (tmp_path / ("sub" if k % 2 else "") / name).write_bytes(content)
    found = word_files.bodies(word_files.read_files(spark, str(tmp_path)))
    name = lambda r: r.path.rsplit("/", 1)[1]
    by = {name(r): r for r in found.collect()}
    assert {n for n, r in by.items() if r.error} == {"bad.docx", "part.docx", "xml.docx"} and not {"other.txt", "zero.docx"} & set(by)
    assert by["a.docx"].title == "A title" and [i.bytes for i in by["a.docx"].images] == [b"one", b"two"] and by["none.docx"].title is None
    assert [p for p in by["a.docx"].paragraphs if p] == [t for t in texts if t]
    pages = sorted(word_files.pages(found, source_queries.CAPTION).collect(), key=lambda r: (name(r), r.page))
    assert [(name(r), r.page, r.image and bytes(r.image)) for r in pages] == [("a.docx", 1, b"one"), ("a.docx", 2, b"two"), ("empty.docx", 1, None), ("none.docx", 1, None)]
    around = "First line Figure 2: a chart " + "x" * 900 + " after it"
    assert pages[0].caption == "Figure 2: a chart" and pages[0].surrounding == around[:800] + "..." and pages[1].caption == "Figure 2: a chart"
    assert pages[2].surrounding is None and pages[3].surrounding == around[:800] + "..."


def shards(folder, first, n):
    for s in range(first, first + n):
        rows = [{"k": 100 * s + i, "text": None if (s + i) % 4 == 0 else f"text {s}.{i}", "other": i} for i in range(7 + s)]
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/s{s:03d}.parquet", row_group_size=3)


def test_pulled_stream_goes_on_after_a_restart(spark, tmp_path):
    """Stopped in the middle, with shards added later: the stream gives what the batch gives, each item once."""
    pulled.register(spark)
    (tmp_path / "in").mkdir()
    shards(tmp_path / "in", 0, 3)
    source = lambda r, **o: r.format("items").option("path", str(tmp_path / "in")).options(**o)

    def run(batches=None, **options):
        seen = []
        sink = lambda df, epoch: (df.write.mode("append").parquet(str(tmp_path / "out")), seen.append(epoch))
        q = source(spark.readStream, groups="1", **options).load().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "log")).start()
        if batches is None:
            q.processAllAvailable()
        else:
            while len(seen) < batches and q.isActive:
                q.awaitTermination(0.05)
        q.stop()
        return seen

    rows = lambda df: sorted((r.item_id, r.place, r.k, r.text, r.other) for r in df.collect())
    assert run(2)
    half = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < half < source(spark.read).load().count()
    shards(tmp_path / "in", 3, 2)
    assert len(run()) > 2
    batch = source(spark.read).load()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    every = [(100 * s + i, (s + i) % 4 == 0) for s in range(5) for i in range(7 + s)]
    assert [(r[0], r[2]) for r in rows(batch)] == [(f"item_{p:09d}", k) for p, (k, bad) in enumerate(every) if not bad]


def test_pulled_limit_counts_good_items(spark, tmp_path):
    pulled.register(spark)
    (tmp_path / "in").mkdir()
    shards(tmp_path / "in", 0, 4)
    for limit in (0, 1, 5, 8, 1000):
        load = lambda r: r.format("items").option("path", str(tmp_path / "in")).option("limit", str(limit)).option("columns", "k").option("groups", "2").load()  # noqa: E731, B023
        want = [100 * s + i for s in range(4) for i in range(7 + s) if (s + i) % 4][:limit]
        assert sorted(r.k for r in load(spark.read).collect()) == want
        q = load(spark.readStream).writeStream.format("memory").queryName(f"limit{limit}").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.k for r in spark.table(f"limit{limit}").collect()) == want


@pytest.mark.parametrize("trigger", [{"availableNow": True}, {"processingTime": "0 seconds"}, {"once": True}])
def test_metric_rows_are_the_batch_counts(spark, tmp_path, trigger):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = progress.observed(stream, "totals", F.count("*").alias("n"), F.sum("value").alias("v"), F.max("event_id").alias("last"))
    name = "m" + next(iter(trigger))
    log = progress.MetricLog(spark, str(tmp_path / "metrics"), name)
    spark.streams.addListener(log)
    try:
        q = seen.writeStream.format("noop").queryName(name).option("checkpointLocation", str(tmp_path / "log")).trigger(**trigger).start()
        if "processingTime" in trigger:
            q.processAllAvailable()
            q.stop()
        else:
            q.awaitTermination()
        progress.drained(spark)
    finally:
        spark.streams.removeListener(log)
    rows = progress.metric_rows(spark, str(tmp_path / "metrics")).collect()
    metrics = [json.loads(r.metrics) for r in rows if r.rows]
    want = events.agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.max("event_id").alias("last")).head()
    assert sum(r.rows for r in rows) == sum(m["totals.n"] for m in metrics) == want.n
    assert sum(m["totals.v"] or 0 for m in metrics) == pytest.approx(want.v) and max(m["totals.last"] for m in metrics) == want.last
    assert len({r.batch for r in rows}) == len(rows) and (len(metrics) == 1) == ("once" in trigger)
