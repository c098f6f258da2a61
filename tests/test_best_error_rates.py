"""Least error rates: one sort of a chart's texts, without joins and hash maps of all targets; results as by brute force."""

from __future__ import annotations

from chartloom.operators import merges as M


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rates_are_those_of_brute_force(spark):
    p = [(1, "Abc"), (1, "abc "), (1, "axxx"), (1, " "), (1, None), (2, "long text"), (None, "same"), (4, "q")]
    t = [(1, 1, "abd"), (1, 2, "ZZ"), (1, 2, "axx"), (1, 3, ""), (1, 4, None), (1, None, "abc"), (2, 1, "long"), (3, 1, "none"), (None, 1, "same"), (1, 5, " ABC ")]
    rows = M.best_error_rates(spark.createDataFrame(p, "k long, text string"), spark.createDataFrame(t, "k long, pos long, text string"), "k")
    clean = lambda x: (x or "").strip().lower()
    want = {}
    for k, pos, x in t:
        if clean(x):
            rate = min((round(_distance(clean(y), clean(x)) / len(clean(x)), 6) for c, y in p if c == k and k is not None and clean(y)), default=1.0)
            want[k, pos] = min(rate, want.get((k, pos), rate))
    got = [((r.k, r.pos), r.cer) for r in rows.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_a_task_holds_one_sort(spark):
    p, t = spark.createDataFrame([(1, "a")], "k long, text string"), spark.createDataFrame([(1, 1, "b")], "k long, pos long, text string")
    plan = M.best_error_rates(p, t, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan, plan
    plan = M.best_error_rates(p, t, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1, plan
