"""File sources on small folders, and reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chartloom.functions import numeric
from chartloom.operators import events as E
from chartloom.operators import facts as X
from chartloom.operators import merges as M
from chartloom.operators import reports as P
from chartloom.plans import fact_queries
from chartloom.sources import files, sinks


def test_records_take_columns_from_paths(spark, tmp_path):
    for kind, name, text in (("bar", "c1", json.dumps({"q": "how many"})), ("line", "c2", "{broken"), ("unknown", "c3", json.dumps({"q": "x"})), ("pie", "c1", json.dumps({"q": "newer"}))):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{name}.json").write_text(text)
    got = files.records(spark, f"{tmp_path}/*/*.json", "q string").select("chart_type", "chart_id", "q").collect()
    assert [tuple(r) for r in got] == [("pie", "c1", "newer")]


def test_inventory_counts_without_reading(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PNG").write_bytes(b"1234")
    (tmp_path / "a" / "y.png").write_bytes(b"12")
    (tmp_path / "a" / "z.txt").write_bytes(b"1" * 100)
    got = {(r.folder, r.extension): (r.files, r.bytes) for r in files.inventory(spark, str(tmp_path), 50).collect()}
    assert got == {("a", ".png"): (2, 6)}


def test_markdown_images_and_placeholder(spark):
    docs = spark.createDataFrame([(1, "a ![x](one.png) b ![](http://far/two.png) ![y](three.jpg \"t\")"), (2, "none"), (3, None)], "k int, t string")
    got = [(r.k, r.image) for r in files.markdown_images(docs, "k", "t").orderBy("k", "pos").collect()]
    assert got == [(1, "one.png"), (1, "three.jpg"), (2, None), (3, None)]


def test_cache_answers_before_computing(spark):
    requests = spark.createDataFrame([("a\\b.png",), ("c.png",), ("d.png",)], "path string")
    cache = spark.createDataFrame([("a/b.png", "hit", None), ("d.png", None, "failed")], "path string, result string, error string")
    got = {r.path: r.result for r in files.with_cache(requests, cache, F.lit("computed")).collect()}
    assert got == {"a\\b.png": "hit", "c.png": "computed", "d.png": ""}


def test_reports(spark):
    rows = spark.createDataFrame([(2, "a&b"), (1, "<c>"), (3, None)], "id int, v string")
    assert P.html_table(rows, ["id", "v"], "id").first().html == "<table><tr><th>id</th><th>v</th></tr><tr><td>1</td><td>&lt;c&gt;</td></tr><tr><td>2</td><td>a&amp;b</td></tr><tr><td>3</td><td></td></tr></table>"
    assert P.latex_rows(rows.where("id = 2"), ["id", "v"], "id").first().latex == r"2 & a\&b \\"
    with pytest.raises(ValueError, match="chatml"):
        P.rendered(F.col("m"), "other")


def test_executors_list_what_a_glob_names(spark, tmp_path, monkeypatch):
    for at in ("s0/qa/bar/a.json", "s0/qa/bar/.a.json.crc", "s0/doc/b.md", "s1/qa/line/deep/down/c.json", "s1/qa/d e%.json", "s1/_log/e.json", "s1/runs/results.json"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(at)
    monkeypatch.setattr(type(spark), "read", property(lambda _: pytest.fail("listed through the driver")))
    below = lambda glob: sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in files.listed(spark, f"{tmp_path}{glob}").collect())
    assert below("") == ["s0/doc/b.md", "s0/qa/bar/a.json", "s1/qa/d e%.json", "s1/qa/line/deep/down/c.json", "s1/runs/results.json"]
    assert below("/*/qa") == ["s0/qa/bar/a.json", "s1/qa/d e%.json", "s1/qa/line/deep/down/c.json"]
    assert below("/*/*/results.json") == ["s1/runs/results.json"]
    assert below("/s[1-9]/{qa,runs}/*.json") == ["s1/qa/d e%.json", "s1/runs/results.json"]
    assert below("/none/*") == below("/none") == []
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content)) for r in files.contents(files.listed(spark, f"{tmp_path}/*/qa"), 3).collect()}
    assert got == {"a.json": (16, b"s0/"), "c.json": (27, b"s1/"), "d e%.json": (15, b"s1/")}


def test_records_of_odd_files(spark, tmp_path):
    for name, text in (("a", '{"q": "x"} '), ("b", '[{"q": "y"}, {"q": "z"}]'), ("c", ""), ("d", "[1"), ("e", '{"q": 5, "n": "no number"}'), ("f", "{}")):
        (tmp_path / f"r{name}").mkdir()
        (tmp_path / f"r{name}" / "results.json").write_text(text)
    glob, schema = f"{tmp_path}/*/results.json", "q string, n int"
    want = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(glob).cache().where("_bad IS NULL")
    got = files.records(spark, glob, schema, typed=False)
    assert sorted((r.chart_type, r.q) for r in got.collect() if r.q) == [("ra", "x"), ("rb", "y"), ("rb", "z")]
    assert got.count() == want.count() == 4


def test_one_text_a_key(spark, tmp_path):
    rows = [("r", "a=b/c+d é", "one"), ("r", "a=b/c+d é", "two"), ("s", None, "three"), ("s", "%41", "")]
    write = spark.createDataFrame(rows, "kind string, key string, text string")
    sinks.text_each(write, str(tmp_path / "each"), "kind", "key", "text")
    got = sinks.texts_of(spark, str(tmp_path / "each"), "kind", "key").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, spark.read.text(str(tmp_path / "each")).select("kind", "key", "value").collect()), key=str) == sorted(rows, key=str)
    assert not (tmp_path / "each" / "_SUCCESS").exists()  # no committer renames a folder a key in the driver


def test_three_digits_are_those_of_c(spark):
    values = [1.005, 1.125, 1.135, 2.675, 0.00012345, 999.5, 1015.0, 1235.0, 1245.0, -1.115, 1e300, 1.5e-310, 0.0, None, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(X.three_digits(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [None if v is None else f"{v:.3g}" for v in values]


def test_three_digits_take_exact_powers_of_ten(spark, tmp_path):
    prices = (297500.0, 198500.0, 32350.0, 65450.0, 9895.0, 9725.0)
    keys = (18, 31, 44, 57, 83, 96)  # 5 modulo 13: times 10 ** -5
    spark.createDataFrame(list(zip(keys, prices, strict=True)), "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.o_orderkey: r.text for r in fact_queries.three_digits(spark, tmp_path).collect()} == {k: f"{p * 1e-5:.3g}" for k, p in zip(keys, prices, strict=True)}
    powers = spark.range(-30, 30).select("id", numeric.power_of_ten(F.col("id")).alias("p")).collect()
    assert all(r.p == float(f"1e{r.id}") for r in powers)


def test_rate_windows_hold_all_rows_of_their_span(spark):
    rows = [(k, "a" if k % 5 else "b", t, None if k % 11 == 0 else k * 0.25) for k, t in enumerate([0, 0, 3, 7, 7, 9, 10, 10, 11, 19, 20, 20, 21, 30, 31, 41, 55] * 3)]
    d = spark.createDataFrame(rows, "event_id int, event_type string, s int, value double").select("event_id", "event_type", F.timestamp_seconds("s").alias("ts"), "value")
    for k, requests, total in ((r.event_id, r.requests, r.total) for r in E.rate_window(d, "event_type", 10).collect()):
        inside = [v for _, e, t, v in rows if e == rows[k][1] and rows[k][2] - 10 <= t <= rows[k][2]]
        known = [v for v in inside if v is not None]
        assert (requests, total) == (len(inside), sum(known) if known else None)


def test_stems_meet_whole_keys(spark):
    files = spark.createDataFrame([(1, "xx_ab12_p77"), (2, "p7"), (3, "none"), (4, None), (5, "ab12")], "f int, stem string")
    papers = spark.createDataFrame([("p77", 3), ("ab12", 5), ("p7", 4), ("ab12", 9), (None, 0)], "key string, ord int")
    assert sorted((r.f, r.paper) for r in M.first_containing(files, papers, "f", "stem", "key").collect()) == [(1, "p77"), (2, "p7"), (3, None), (4, None), (5, "ab12")]


def test_equal_spreads_are_equal_in_any_order(spark):
    same = [((0, 1, 2, 7), (0, 1, 7, 2)), ((0, 1, 2, 9), (0, 2, 9, 1)), ((0, 1, 2, 10), (0, 1, 10, 2)), ((0, 1, 3, 5), (0, 1, 5, 3)), ((0, 1, 3, 6), (0, 1, 6, 3)), ((0, 1, 3, 7), (0, 1, 7, 3)), ((0, 1, 3, 8), (0, 1, 8, 3)), ((0, 1, 3, 9), (0, 1, 9, 3)), ((0, 1, 3, 10), (0, 1, 10, 3)), ((0, 1, 3, 13), (3, 13, 0, 1)), ((0, 1, 4, 6), (1, 4, 0, 6)), ((0, 1, 4, 7), (0, 1, 7, 4))]
    rows = [(k, x, 0, y, 0) for k, (xs, ys) in enumerate(same) for x, y in zip(xs, ys, strict=True)]
    d = spark.createDataFrame(rows, "chart_id int, x0 long, x1 long, y0 long, y1 long").coalesce(1)
    assert {r.axis for r in X.profile_axis(d).collect()} == {"x"}
    assert {r.axis for r in X.profile_axis(d.selectExpr("chart_id", "y0 + 1 AS y0", "y1", "x0 * 2 AS x0", "x1")).collect()} == {"x"}
