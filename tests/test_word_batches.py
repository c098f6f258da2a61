"""Word files: batches are bounded by bytes, rows become objects one at a time, and each file is taken apart once."""

from __future__ import annotations

from chartloom.sources import word_files as W


def test_each_file_is_read_once_in_bounded_batches(spark):
    rows = [("a", "T", ["x", "Figure 1: y", " z "], [(0, bytearray(b"p")), (0, bytearray(b"q")), (2, bytearray(b"r"))]), ("b", None, [" l ", "", "m"], []), ("c", None, [], [])]
    files = W.files_of(spark.createDataFrame(rows, "path string, title string, paragraphs array<string>, images array<struct<after:int,bytes:binary>>"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 16 << 20
    pages = W.pages(W.bodies(files), "^figure")
    got = {(r.path, r.page, r.title, r.image and bytes(r.image), r.surrounding, r.caption) for r in pages.collect()}
    f = "Figure 1: y"
    assert got == {("a", 1, "T", b"p", f"x {f} z", f), ("a", 2, "T", b"q", f"x {f} z", f), ("a", 3, "T", b"r", f"{f} z", f), ("b", 1, None, None, "l m", None), ("c", 1, None, None, None, None)}
    plan = pages._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2, plan  # four where pages with and without images are apart
