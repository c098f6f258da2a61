"""Word files: zipped XML, read by Spark as binary files and taken apart in Arrow batches.

A page is an embedded image with the paragraphs around it, or, in a file without any, one placeholder with the text of the
whole body. Rendering pages needs an office suite, so that branch stays out. Files that are no readable archives give a row
with `error` and no page, so that a bad file neither stops the others nor goes unseen.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.scratch import bound_batches

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
_EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
_DC = "{http://purl.org/dc/elements/1.1/}title"
#: Paragraphs on either side that are an image's context.
RADIUS = 3
BODY = "path string, title string, paragraphs array<string>, images array<struct<paragraph:int,name:string,bytes:binary>>, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the Word files below a folder; Spark lists and deals them out, all but empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def body_of(content: bytes) -> tuple[str | None, list[str], list[dict]]:
    """(title, paragraphs, images) of a file; an image whose part is missing is none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        title = None
        if "docProps/core.xml" in names:
            found = ElementTree.fromstring(z.read("docProps/core.xml")).find(f".//{_DC}")
            title = found.text.strip() if found is not None and found.text and found.text.strip() else None
        parts = {}
        if "word/_rels/document.xml.rels" in names:
            parts = {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target", ""))) for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        paragraphs, images = [], []
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{_W}p"):
            for blip in p.iter(_BLIP):
                name = parts.get(blip.get(_EMBED))
                if name in names:
                    images.append({"paragraph": len(paragraphs), "name": name, "bytes": z.read(name)})
            paragraphs.append("".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")))
        return title, paragraphs, images


def bodies(files: DataFrame) -> DataFrame:
    """A row for each file of (path, content): title, paragraphs, images with the paragraph that holds them, or the error."""
    schema = pa.schema([("path", pa.string()), ("title", pa.string()), ("paragraphs", pa.list_(pa.string())), ("images", pa.list_(pa.struct([("paragraph", pa.int32()), ("name", pa.string()), ("bytes", pa.binary())]))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):  # a file at a time: images are large
                try:
                    row = (path.as_py(), *body_of(content.as_py() or b""), None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError) as e:
                    row = (path.as_py(), None, [], [], f"{type(e).__name__}")
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return bound_batches(files).select("path", "content").mapInArrow(run, BODY)


def pages(found: DataFrame, caption: str, limit: int = 800) -> DataFrame:
    """(path, page, title, image, surrounding, caption): the pages of bodies(); errors give none.

    caption: the pattern of a caption; the first paragraph around an image that has it is the image's. Context beyond `limit`
    characters ends in dots; white space in it is single.
    """
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | $", "")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    cut = lambda c: F.when(c == "", None).otherwise(F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c))
    some = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    # one row for each image and one for a file without any, so that each file is taken apart once
    at = found.where("error IS NULL AND images IS NOT NULL").select("path", "title", "paragraphs", F.posexplode_outer("images").alias("k", "image"))
    p, alone = F.col("image.paragraph"), F.col("k").isNull()
    around = some(F.concat(F.slice("paragraphs", F.greatest(p - RADIUS, F.lit(0)) + 1, F.least(p, F.lit(RADIUS))), F.slice("paragraphs", p + 2, F.lit(RADIUS))))
    texts = F.when(alone, F.filter("paragraphs", lambda x: strip(x) != "")).otherwise(around)
    found = at.select("path", F.coalesce(F.col("k") + 1, F.lit(1)).alias("page"), "title", F.col("image.bytes").alias("image"), texts.alias("texts"), alone.alias("alone"))
    caption_of = F.when(~F.col("alone"), F.get(F.filter("texts", lambda x: F.lower(x).rlike(caption)), F.lit(0)))
    return found.select("path", "page", "title", "image", cut(clean(F.array_join("texts", "\n"))).alias("surrounding"), caption_of.alias("caption"))


def files_of(rows: DataFrame) -> DataFrame:
    """(path, content) of Word files made by executors from (path, title, paragraphs, images): image k stands in a paragraph of its own behind paragraph k of `images`, an array of (after, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a row at a time: a batch of long texts is many times larger as Python's objects
                r = b.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([archive(r["title"], r["paragraphs"], r["images"])], pa.binary())], names=["path", "content"])

    return bound_batches(rows).select("path", "title", "paragraphs", "images").mapInArrow(run, "path string, content binary")


def archive(title: str | None, paragraphs: list[str], images: list[dict]) -> bytes:
    """The smallest Word file with these parts; characters that XML forbids are left out."""
    w, a, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    fit = lambda t: "".join(c for c in t if c in "\t\n" or " " <= c and c not in "￾￿")
    body = ElementTree.Element(f"{{{w}}}body")

    def paragraph() -> ElementTree.Element:
        return ElementTree.SubElement(ElementTree.SubElement(body, f"{{{w}}}p"), f"{{{w}}}r")

    behind: dict[int, list[int]] = {}
    for i, image in enumerate(images):
        behind.setdefault(image["after"], []).append(i)
    for k, text in enumerate(paragraphs):
        ElementTree.SubElement(paragraph(), f"{{{w}}}t").text = fit(text)
        for i in behind.get(k, ()):
            ElementTree.SubElement(ElementTree.SubElement(paragraph(), f"{{{w}}}drawing"), f"{{{a}}}blip").set(f"{{{r}}}embed", f"rId{i}")
    document = ElementTree.Element(f"{{{w}}}document")
    document.append(body)
    links = "".join(f'<Relationship Id="rId{i}" Type="image" Target="media/image{i}.png"/>' for i in range(len(images)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(document))
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{links}</Relationships>")
        core = ElementTree.Element("coreProperties")
        ElementTree.SubElement(core, _DC).text = fit(title or "")
        z.writestr("docProps/core.xml", ElementTree.tostring(core))
        for i, image in enumerate(images):
            z.writestr(f"word/media/image{i}.png", image["bytes"])
    return out.getvalue()
