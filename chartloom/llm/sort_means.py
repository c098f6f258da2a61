"""Centroid clustering by sort-means, in whole numbers.

Every component x of a vector becomes floor(scale * x). A round sorts, for each centroid, the other centroids by
their distance from it. A vector begins at the centroid it was assigned to and tries that centroid's neighbours
in this order; a neighbour beyond twice the vector's distance from its centroid can't be nearer by the triangle inequality, nor can any
after it, so the scan stops strictly beyond (at exactly twice the distance a tie is still possible, and ties go to the smaller number). Squares are compared:
D > 4 d. All arithmetic is exact.

A round is one pass: tasks read the table of the round before, assign its vectors in blocks and write them with their new centroid; at
its end each task adds a row for each centroid, the count and the sum of its vectors. Only these sums, k rows of them, reach the driver, which
divides and deals out the next centroids (k vectors, whatever the input). The table a round supersedes is erased. A lost executor
costs its tasks of the running round, no more.

Vectors of another length, or with a null, NaN or infinite component, are left out; so are those with a scaled component of
LIMIT or more in magnitude, since their squared distances need not fit a long. A null vec_id counts as empty
text in the hash; rows that repeat a vec_id each count, equal hashes in order of their components. Fewer vectors than centroids make as many centroids as vectors; none, or an empty
table, give an empty result. Sums of distances that pass a long are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.graph import Scratch, bound_batches, cut

#: Scaled components below this: a squared difference is below 2**56, and 64 of them below 2**62.
LIMIT = 1 << 27
#: Vectors that are compared at once.
BLOCK = 4096

_ROWS = "vec_id long, x array<int>, cluster int, distance long, n long, sums array<long>"


def quantized(embeddings: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, x): the vectors that are kept, as whole numbers."""
    fit = lambda x: F.coalesce(F.abs(x.cast("double")) * scale < LIMIT, F.lit(False))  # noqa: E731  false for null, NaN and infinity
    kept = (F.size("embedding") == dims) & F.forall("embedding", fit)
    x = F.when(kept, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("x IS NOT NULL")


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid: the others by distance from it, ties by number, and a quarter of those squared distances, rounded up."""
    far = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    k = len(centroids)
    order = np.array([[o for o in sorted(range(k), key=lambda o: (far[c, o], o)) if o != c] for c in range(k)], np.int64).reshape(k, k - 1)
    return order, -(-np.take_along_axis(far, order, 1) // 4)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, and how many distances that took. before: where each vector's scan begins."""
    best, where, tried = np.empty(len(x), np.int64), before.astype(np.int64), len(x)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = ((x[rows] - centroids[c]) ** 2).sum(1)
        by = np.argsort(-own, kind="stable")
        rows, own = rows[by], own[by]
        some, d, to = x[rows], own.copy(), np.full(len(rows), c, np.int64)
        tries = np.searchsorted(quarter[c], own, "right")  # neighbours no further than twice the own distance; fewer from row to row
        for j in range(int(tries[0])):
            m = int(np.searchsorted(-tries, -j, "left"))  # rows that try more than j neighbours
            o = order[c, j]
            e = ((some[:m] - centroids[o]) ** 2).sum(1)
            nearer = (e < d[:m]) | ((e == d[:m]) & (o < to[:m]))
            d[:m][nearer], to[:m][nearer] = e[nearer], o
            tried += m
        best[rows], where[rows] = d, to
    return where, best, tried


def _assign(centroids: np.ndarray):
    order, quarter = neighbours(centroids)
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            before = b.column(2).to_numpy(zero_copy_only=False)
            where, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
            for a in range(0, len(x), BLOCK):
                e = slice(a, a + BLOCK)
                where[e], best[e], _ = nearest(x[e], before[e], centroids, order, quarter)
            count += np.bincount(where, minlength=k)
            np.add.at(total, where, x)
            n = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where.astype(np.int32)), pa.array(best), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=["vec_id", "x", "cluster", "distance", "n", "sums"])
        some = np.flatnonzero(count)
        m = len(some)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dims), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(some.astype(np.int32)), pa.nulls(m, pa.int64()), pa.array(count[some]), sums], names=["vec_id", "x", "cluster", "distance", "n", "sums"])

    return run


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of each component; empty ones stay."""
    dims = centroids.shape[1]
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in table.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of `seed:vec_id`, in that order."""
    drawn = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in drawn], np.int64)


def clustered(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = bound_batches(embeddings).sparkSession
    scratch = Scratch()
    vectors = quantized(embeddings, dims, scale)
    now = cut(vectors.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<long>").alias("sums")), scratch)
    centroids = first_centroids(now, k, seed)
    if not len(centroids):
        return now.select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for r in range(rounds + 1):
        last, now = now, cut(now.where("n IS NULL").select("vec_id", "x", "cluster").mapInArrow(_assign(centroids), _ROWS), scratch)
        scratch.drop(last)
        if r < rounds:
            centroids = _moved(now, centroids)
    now = now.where("n IS NULL")
    inertia = {r["cluster"]: int(r["d"]) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    fit = lambda v: v if v < 2**63 else None
    facts = [(c, fit(d), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    side = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
