"""Plug-ins, settings, schemas, sinks, quotas and streams on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.operators import dataset as D
from chartloom.operators import sessions as S
from chartloom.operators import stages as G
from chartloom.sources import files, sinks
from chartloom.streaming import jobs


def test_registry_knows_names_in_any_case():
    r = G.Registry()
    r.register("stage", "One")(1)
    assert r.resolve("stage", "oNE") == 1 and r.is_registered("stage", "ONE") and not r.is_registered("other", "one")
    assert r.names("stage") == ["one"]
    with pytest.raises(ValueError, match="known: one"):
        r.resolve("stage", "two")
    with pytest.raises(ValueError, match="already"):
        r.register("stage", "one")(2)


def test_stage_falls_back_where_rows_are_not_valid(spark):
    rows = spark.createDataFrame([(1, 640, 400), (2, 0, 400), (3, None, 5)], "image_id long, width long, height long")
    got = G.MockDetector(2)(rows).collect()
    assert sorted((r.image_id, r.box) for r in got) == [(1, 0), (1, 1), (2, -1), (3, -1)]
    assert all(0 <= r.x0 < r.x1 <= 640 and 0 <= r.y0 < r.y1 <= 400 for r in got if r.box >= 0)


def test_layered_settings():
    got = files.layered_config({"a": {"x": 1, "y": 2}, "p": "/in"}, {"a": {"y": 3}, "q": "${p}/${a.y}", "r": "${a.x}"})
    assert got == {"a": {"x": 1, "y": 3}, "p": "/in", "q": "/in/3", "r": 1}
    with pytest.raises(ValueError, match="circular"):
        files.layered_config({"a": "${b}", "b": "${a}"})
    with pytest.raises(KeyError):
        files.layered_config({"a": "${none}"})


def test_json_schema():
    kind = T.StructType().add("id", T.LongType(), False).add("names", T.ArrayType(T.StringType())).add("by", T.MapType(T.StringType(), T.DoubleType()))
    assert sinks.json_schema(kind) == {"type": "object", "properties": {"id": {"type": "integer"}, "names": {"type": "array", "items": {"type": "string"}}, "by": {"type": "object", "additionalProperties": {"type": "number"}}}, "required": ["id"]}


def test_json_files_appear_whole(spark, tmp_path):
    for value in ({"a": 1}, {"a": "é"}):
        sinks.save_json(spark, str(tmp_path), "out/x.json", value)
    assert json.loads((tmp_path / "out" / "x.json").read_text()) == {"a": "é"}
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_inventory_stops_at_a_depth(spark, tmp_path):
    files.put(spark, str(tmp_path), {"a.txt": "1", "b/c.txt": "22", "b/d/e.txt": "333"})
    assert sorted((r.files, r.bytes) for r in files.inventory(spark, str(tmp_path), depth=1).collect()) == [(1, 1), (1, 2)]


def test_quota_sample_prefers_new_papers_and_relaxes(spark):
    rows = [(k, "bar" if k < 12 else "pie", ("simple", "moderate")[k % 2] if k < 12 else "simple", k % 3) for k in range(16)]
    d = spark.createDataFrame(rows, "chart_id int, kind string, level string, paper int")
    got = D.quota_sample(d, "kind", "level", "chart_id", "paper", {"bar": {"simple": 2, "moderate": 1}, "pie": {"complex": 2}}).collect()
    by = {(r.kind, r.wanted): [x.chart_id for x in got if (x.kind, x.wanted) == (r.kind, r.wanted)] for r in got}
    paper, level = {r[0]: r[3] for r in rows}, {r[0]: r[2] for r in rows}
    assert {k: len(v) for k, v in by.items()} == {("bar", "simple"): 2, ("bar", "moderate"): 1, ("pie", "complex"): 2}
    assert all(level[c] == "simple" for c in by["bar", "simple"]) and level[by["bar", "moderate"][0]] == "moderate"
    assert paper[by["bar", "moderate"][0]] not in {paper[c] for c in by["bar", "simple"]} or len({paper[c] for c in by["bar", "simple"]}) == 3
    assert len({c for v in by.values() for c in v}) == 5


def test_ranks_are_those_of_one_sort(spark):
    d = spark.createDataFrame([(k, None if k % 3 == 0 else f"g{k % 2}") for k in range(500)], "k int, g string")
    got = {r.k: (r.rank, r.n) for r in D.ranked(d, ["g"], "k", digits=1).collect()}
    import hashlib

    draw = lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()
    for g in {r.g for r in d.select("g").distinct().collect()}:
        ks = sorted((r.k for r in d.where(F.col("g").eqNullSafe(F.lit(g))).collect()), key=lambda k: (draw(k), k))
        assert [got[k] for k in ks] == [(i + 1, len(ks)) for i in range(len(ks))]


def test_retries(spark):
    rows = [(1, 1, True, False), (2, 1, False, False), (2, 2, True, False), (3, 1, False, True), (3, 2, True, False), (4, 1, False, False), (4, 2, False, False), (4, 3, False, False)]
    got = {r.request_id: tuple(r)[1:] for r in S.retried(spark.createDataFrame(rows, "request_id int, k int, ok boolean, auth_error boolean")).collect()}
    assert got == {1: (1, "succeeded", 0), 2: (2, "succeeded", 1), 3: (1, "aborted", 0), 4: (3, "exhausted", 3)}


def test_upserts_keep_the_newest_row_of_a_batch(spark, tmp_path):
    write = jobs.upsert_sink(str(tmp_path / "u"), "id", "at")
    schema = "id int, at int, v string"
    for epoch in (0, 0):  # a batch that comes again changes nothing
        write(spark.createDataFrame([(1, 5, "new"), (1, 3, "old"), (2, 1, "b")], schema), epoch)
    write(spark.createDataFrame([(2, 2, "c")], schema), 1)
    assert {(r.id, r.at, r.v) for r in jobs.latest_of(spark, str(tmp_path / "u"), "id").collect()} == {(1, 5, "new"), (2, 2, "c")}
