"""Connected components by alternating star contraction, without collecting edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.sources.scratch import Scratch, cut

#: Edges that a task contracts at once.
LOT = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the smallest one that the edges (a, b) reach, itself left out."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contracted(batches):
    """Lots of edges as stars: what they connect stays connected, with an edge a vertex at most."""
    held, n = [], 0

    def lot():
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in held)]) for k in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], names=["u", "v"])

    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= LOT:
            yield lot()
            n = 0
    yield lot()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of edges (a, b); component is the smallest id reachable.

    Lots of edges of whole-number ids become stars first, so edges that lie together are settled where they lie. Large-star and small-star
    steps then alternate until there are only stars. A vertex's minimum is found by a
    pre-aggregated groupBy and joined back, so a vertex with very many edges never sits in one group.
    Nulls and loops are ignored; an empty input gives an empty result.
    """
    scratch = Scratch()
    real = edges.where("a <> b").select("a", "b")
    if {t for _, t in real.dtypes} == {"bigint"}:
        pairs = real.mapInArrow(_contracted, "u long, v long")
    else:
        pairs = real.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(pairs.distinct(), scratch)
    for _ in range(rounds):
        # a vertex below two others, or between others: not yet a star
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").head(1):
            break
        # large star: each u gives the neighbours above it its smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each u joins the neighbours below it to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        last, e = e, cut(pairs.where("u <> v").distinct(), scratch)
        scratch.drop(last)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
