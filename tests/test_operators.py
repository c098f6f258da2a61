"""Reference operators on literal rows, and the queries against their oracles at the smallest scale."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from chartloom.functions import numeric as N
from chartloom.functions import text as T
from chartloom.operators import calibrate as C
from chartloom.operators import dataset as D
from chartloom.operators import events as E
from chartloom.operators import geometry as G
from chartloom.operators import insights as I
from chartloom.operators import joins as J
from chartloom.operators import reshape as R
from chartloom.plans import catalogue
from chartloom.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def points(spark, **series):
    rows = [(1, name, k, i, f"p{i}", float(v), 0.95) for k, (name, vs) in enumerate(series.items()) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "chart_id long, series_name string, series_idx int, point_idx int, label string, value double, confidence double")


@pytest.mark.parametrize(("values", "want"), [((10, 20, 30, 40), "increasing"), ((40, 30, 20, 10), "decreasing"), ((10.0, 10.1, 9.9, 10.0), "stable"), ((10, 20), None)])
def test_trend(spark, values, want):
    got = I.trends(points(spark, s=values)).collect()
    assert [r.direction for r in got] == ([want] if want else [])


def test_anomaly_and_comparison(spark):
    got = I.anomalies(points(spark, Sales=(100, 102, 98, 101, 99, 100, 900))).collect()
    assert [(r.point_idx, r.value) for r in got] == [(6, 900.0)]
    top = I.comparisons(points(spark, Revenue=(10, 15, 20, 25), Expenses=(8, 9, 10, 11))).first()
    assert (top.dominant, top.lowest) == ("Revenue", "Expenses")


def test_insights_are_capped_and_warnings_listed(spark):
    assert I.top_insights(points(spark, **{f"s{i}": (10 * i, 20 * i, 30 * i, 400 * i, 50 * i) for i in range(1, 5)}), 3).count() == 3
    odd = points(spark, a=(1, float("nan"), 3), b=(1, 2, float("inf")))
    assert sorted(r.warning for r in I.validation_warnings(odd).collect()) == ["non_finite at 1", "non_finite at 2"]


@pytest.mark.parametrize(
    ("text", "headers", "rows"),
    [
        ("Year | Revenue<0x0A>2021 | 100<0x0A>2022 | 150", ["Year", "Revenue"], [["2021", "100"], ["2022", "150"]]),
        ("TITLE | Revenue Trend<0x0A>Year | Revenue<0x0A>2021 | 100", ["Year", "Revenue"], [["2021", "100"]]),
        ("", [], []),
        ("Category | Label<0x0A>foo | bar<0x0A>baz | qux", [], []),
        ("Product<0x0A>Sales<0x0A>A | 10<0x0A>B | 20", ["Product Sales", "col1"], [["A", "10"], ["B", "20"]]),
    ],
)
def test_linear_tables(spark, text, headers, rows):
    t = R.parsed(spark.createDataFrame([(1, text)], "k int, text string"), "text").first().t
    assert (t.headers, t.rows) == (headers, rows)


def test_number_parsers_differ(spark):
    texts = ["1,234", "42%", "1.5K", "$100", "1O", "x", "1d", "0x1p3", " 2M "]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", N.parse_mapper(F.col("t")), N.parse_metric(F.col("t")), N.parse_demo(F.col("t"))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {
        "1,234": (1234, 1234, 1234), "42%": (42, 42, 42), "1.5K": (1500, 1500, 1500), "$100": (None, None, 100), "1O": (10, None, None), "x": (None, None, None), "1d": (None, None, None), "0x1p3": (None, None, None), " 2M ": (2e6, 2e6, 2e6),
    }


def test_text_metrics(spark):
    d = spark.createDataFrame([("Hello  World", "hello world"), ("kitten", "sitting"), ("", ""), ("abc", "")], "p string, t string")
    got = d.select(T.exact_match(F.col("p"), F.col("t")), F.round(T.anls(F.col("p"), F.col("t")), 4), F.round(T.cer(F.col("p"), F.col("t")), 4), T.bleu_1(F.col("p"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, 1.0, 0.0, 1.0), (False, 0.5714, 0.4286, 0.0), (True, 1.0, 0.0, 0.0), (False, 0.0, 1.0, 0.0)]


def test_ocr_cleanup(spark):
    d = spark.createDataFrame([("1O5", 0.9), ("Oil", 0.9), ("12,5", 0.9), ("5 %", 0.9), ("a  b", 0.9)], "t string, c double")
    assert [r[0] for r in d.select(T.ocr_cleanup(F.col("t"), F.col("c"))).collect()] == ["105", "Oil", "12.5", "5%", "a b"]


def test_calibration(spark):
    ticks = spark.createDataFrame([("y", 390.0, 0.0), ("y", 240.0, 50.0), ("y", 90.0, 100.0), ("one", 1.0, 1.0)], "axis_id string, pixel double, value double")
    fit = {r.axis_id: r for r in C.ols(ticks).collect()}
    assert set(fit) == {"y"}
    assert abs(fit["y"].intercept + fit["y"].slope * 240 - 50) < 1e-3 and fit["y"].r2 == 1
    assert C.theil_sen(ticks).where("axis_id = 'y'").first().slope == pytest.approx(-1 / 3, abs=1e-6)
    assert C.ransac_pairs(ticks).where("axis_id = 'y'").first().inliers == 3


def test_axis_values(spark):
    rows = [(50.0, 0.0, 100.0, 0.0, 100.0, False), (200.0, 0.0, 200.0, 0.0, 100.0, True), (250.0, 100.0, 400.0, 2020.0, 2025.0, False)]
    d = spark.createDataFrame(rows, "p double, p0 double, p1 double, v0 double, v1 double, inv boolean")
    assert [r[0] for r in d.select(N.axis_value(*(F.col(c) for c in ("p", "p0", "p1", "v0", "v1", "inv")), F.lit(False))).collect()] == [50.0, 0.0, 2022.5]


def test_splits_leak_no_group(spark):
    rows = spark.createDataFrame([(k % 100, k) for k in range(1000)], "g int, k int")
    got = D.group_split(rows, "g").select("g", "split").distinct().collect()
    assert len(got) == 100
    assert sorted(sum(r.split == s for r in got) for s in ("train", "val", "test")) == [5, 10, 85]


def test_merges(spark):
    old, new = (spark.createDataFrame(r, "id int, at int, v string") for r in ([(1, 1, "a"), (2, 1, "b")], [(2, 2, "c"), (3, 1, "d"), (3, 2, "e")]))
    assert {tuple(r) for r in D.upsert(old, new, "id", "at").collect()} == {(1, 1, "a"), (2, 2, "c"), (3, 2, "e")}
    assert {tuple(r) for r in D.insert_if_absent(old, new, "id").collect()} == {(1, 1, "a"), (2, 1, "b"), (3, 1, "d"), (3, 2, "e")}


def test_boxes_and_paths(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 1.0, 10.0, 10.0), (1, 3, 50.0, 50.0, 60.0, 60.0)], "chart long, box long, x0 double, y0 double, x1 double, y1 double")
    assert {r.box for r in J.suppressed(boxes, "chart", "box").collect()} == {1, 3}
    assert J.overlaps(boxes, "chart", "box").first().iou == 0.81
    path = spark.createDataFrame([(1, k, float(k), 5.0 if k == 3 else 0.0) for k in range(7)], "path long, pos long, x double, y double")
    assert {0, 3, 6} <= {r.pos for r in G.simplified(path, "path", 1.0).collect()}
    ring = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(3.0, 2.0), (1.0, 4.0), (-1.0, 2.0), (1.0, 0.0)])], "path long, pos long, x double, y double")
    c = G.circles(ring, "path").first()
    assert (c.cx, c.cy, c.radius) == (1.0, 2.0, 2.0)


def test_provider_fallback(spark):
    rows = [(1, 0, "a", True, True, 0.9), (1, 1, "b", True, True, 0.9), (2, 0, "a", False, True, 0.9), (2, 1, "b", True, True, 0.1), (3, 0, "a", True, True, 0.1), (3, 1, "b", True, True, 0.8), (4, 0, "a", True, False, 0.9)]
    got = E.fallback(spark.createDataFrame(rows, "request_id int, chain_pos int, provider string, healthy boolean, success boolean, confidence double")).collect()
    assert {r.request_id: (r.provider, r.outcome) for r in got} == {1: ("a", "answered"), 2: ("b", "answered"), 3: ("b", "answered"), 4: (None, "exhausted")}


def _stream_folder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for part in range(3):
        rows = [(part * 10 + k, start + dt.timedelta(minutes=part * 30 + k), k % 2, "view" if k < 9 else "purchase", 1.0, "{}") for k in range(10)]
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    folder = _stream_folder(spark, tmp_path)
    q = jobs.windowed_counts(jobs.event_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    batch = E.tumbling(spark.read.schema(jobs.EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), "5 minutes")
    assert got == {(r.start, r.event_type): r.n for r in batch.collect()}


def test_job_states_upsert(spark, tmp_path):
    folder, out = _stream_folder(spark, tmp_path), str(tmp_path / "out")
    q = jobs.job_states(jobs.event_stream(spark, folder)).writeStream.outputMode("update").foreachBatch(jobs.upsert_sink(out, "user_id")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: (r.event_type, r.events) for r in jobs.latest_of(spark, out, "user_id").collect()}
    assert got == {0: ("view", 15), 1: ("purchase", 15)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_queries_agree_with_their_oracle(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*(F.col(f"`{c}`") for c in cols)).collect()
    rel = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = [[r[names.index(c)] for c in cols] for r in rel.fetchall()]
    assert sorted(names) == cols
    assert _norm(got) == _norm(want)
