"""Series by colour: of the two stages each has one sort, not two of all rows at once."""

from __future__ import annotations

from chartloom.operators import calibrate as K


def test_series_and_points(spark):
    rows = [(1, "b", 5, 2), (1, "a", 9, 1), (1, "a", 3, 3), (1, None, 4, 4), (1, "c", None, 0), (2, "z", 1, None), (2, "y", 1, 7), (None, "n", 1, 1)]
    e = spark.createDataFrame(rows, "chart long, colour string, x long, pos long")
    out = K.numbered_series(e, "chart", "colour", "x", "pos")
    assert out.columns == ["chart", "colour", "x", "pos", "series_idx", "point_idx"]
    want = {(*r, s, k) for r, s, k in zip(rows, (2, 1, 1, 3, 0, 0, 1, 0), (0, 1, 0, 0, 0, 0, 0, 0), strict=True)}
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 2, plan
