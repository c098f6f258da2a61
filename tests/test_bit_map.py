"""The bit map that keeps rows from a shuffle: few rows, whatever the keys, and no key missed."""

from __future__ import annotations

from chartloom.operators import joins as J


def test_bit_map_is_broadcast_in_few_rows(spark):
    keys, rows = spark.range(0, 600_000, 3), spark.range(30_000)
    assert J.bit_map(keys, ["id"]).count() <= 1 << 10  # 2**18 rows of one word each before
    marked = J.with_bit(rows, keys, ["id"])
    assert marked.columns == ["id", "_bit"]
    assert marked.where("id % 3 = 0 AND NOT _bit").count() == 0
    assert marked.where("id % 3 <> 0 AND _bit").count() < 1_000
    assert J.likely(rows, keys.where("id < 0"), ["id"]).count() == 0
