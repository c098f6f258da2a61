"""Kinds of curves: what one task holds, and paths that are null, on one place or without coordinates."""

from __future__ import annotations

import math

from chartloom.operators import curves


def _points(spark):
    at = {1: lambda k: (k, 2 * k), 2: lambda k: (4 * math.cos(k / 4), 4 * math.sin(k / 4)), 3: lambda k: (7 + 6 * math.cos(k / 4), 3 * math.sin(k / 4)), 4: lambda k: (5, 5), 5: lambda k: (4 * math.cos(k / 20), 4 * math.sin(k / 20)), None: lambda k: (k, k)}
    rows = [(path, k, *map(float, f(k))) for path, f in at.items() for k in range(24)]
    return spark.createDataFrame([*rows, (6, 1, None, None), (6, 2, 1.0, None)], "path long, pos long, x double, y double")


def test_kinds(spark):
    got = {r.path: (r.n, r.kind, r.fit and round(r.fit, 6)) for r in curves.curve_kinds(_points(spark), "path").collect()}
    assert got == {1: (24, "line", None), 2: (24, "circle", 1.0), 3: (24, "ellipse", 1.0), 4: (24, "line", None), 5: (24, "arc", 1.0), 6: (2, "line", None)}


def test_a_task_holds_two_joins(spark):
    plan = curves.curve_kinds(_points(spark), "path")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 2, plan
    assert curves.fitted_circles(_points(spark), "path")._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
