"""Rows and points of parsed tables: each text is parsed once, and tables without rows give none."""

from __future__ import annotations

from chartloom.operators import reshape as R


def _tables(spark):
    return spark.createDataFrame([(1, "TITLE | t<0x0A>k | a | b<0x0A>x | 1 | 2%<0x0A>y | no | 3<0x0A>z | 4"), (2, "no numbers | here"), (3, ""), (4, None)], "id long, text string")


def test_texts_are_parsed_once(spark):
    t = R.parsed(_tables(spark).repartition(2), "text")
    for rows in (R.records(t, "id"), R.unpivot(t, "id")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("array_position") == 1, plan  # more where a filter by the array's size parses anew


def test_rows_and_points(spark):
    t = R.parsed(_tables(spark), "text")
    rows = sorted(tuple(r) for r in R.records(t, "id").collect())
    assert rows == [(1, r, c, "kab"[c], x[c]) for r, x in enumerate((("x", "1", "2%"), ("y", "no", "3"), ("z", "4", ""))) for c in range(3)]
    points = sorted((r.series_idx, r.point_idx, r.series_name, r.label, r.value) for r in R.unpivot(t, "id").collect())
    assert points == [(0, 0, "a", "x", 1.0), (0, 2, "a", "z", 4.0), (1, 0, "b", "x", 2.0), (1, 1, "b", "y", 3.0)]
