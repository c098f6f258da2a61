"""Rows to learn from: which are held out, and samples of the others that have a hard bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.graph import Scratch, bound_batches, cut, with_bit


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the CRC of its id, never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def bounded(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` of rows (doc_id, text, ...): those of least hash of id and text, under column `draw`. Rows of the same id and text count once.

    Only hashes reach the driver, at most 2 * `most` + 1 of them, thinned before they are sorted.
    """
    drawn = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 2))  # below 2**62
    share = min(1.0, 2 * most / max(rows.select("doc_id").count(), 1))
    end = int(share * 2**62)
    found = drawn.where(F.col("draw") < end).select("draw").distinct().orderBy("draw").limit(most + 1).collect()
    return drawn.where(F.col("draw") < (found[most]["draw"] if len(found) > most else end)).dropDuplicates(["draw"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text, y, draw) of at most `most` labelled documents that aren't held out, in a table of their own.

    Of each label's ids at most `most` / 2 are drawn by hash; they are broadcast, so texts are never shuffled. Null ids
    and labels are ignored; of repeated labels for an id the largest holds. Documents that repeat an id are drawn from by id and text.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    by_hash = (F.xxhash64("doc_id", F.lit(7)), "doc_id")
    few = known.where("y = 1").orderBy(*by_hash).limit(most // 2).unionByName(known.where("y <> 1").orderBy(*by_hash).limit(most // 2))
    met = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id"), scratch)
    return bounded(met, most, 7)


def gathered(rows: DataFrame, columns: list[tuple[str, str]], of: Callable[[pa.Array], dict]) -> pa.Table:
    """What `of` makes of the texts of a bounded sample, in order of draw, with its y where it has one: computed by executors, so that no text reaches the driver.

    columns: (name, Spark type) of each list of values in the dictionary that `of` returns.
    """
    keep = [c for c in ("draw", "y") if c in rows.columns]

    def run(batches):
        for b in batches:
            made = of(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(made[name] for name, _ in columns)], names=[*keep, *(name for name, _ in columns)])

    kinds = {"draw": "draw long", "y": "y int"}
    got = rows.select(*keep, "text").mapInArrow(run, ", ".join([*(kinds[k] for k in keep), *(f"{n} {t}" for n, t in columns)]))
    return got.toArrow().sort_by([("draw", "ascending")])


def vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of `width` numbers as a matrix."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def as_rows(docs: DataFrame) -> DataFrame:
    """docs with each row, all its columns whatever their names, as one struct `row`."""
    return bound_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


#: Stands for a null doc_id: the smallest.
NULL_ID = -(2**63)
#: What names a row, from named().
ROW = ["doc", "hi", "lo"]


def named(rows: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """rows with doc, hi, lo: rows that differ in doc_id or text differ in these, and their order is by doc_id, null first.

    hi and lo are the MD5 digest of the text where the id may occur more than once (a bit map of the ids that do
    tells, 2 MB whatever the input), else 0: unique ids need no digest, and zeros cost nothing in a shuffle.
    """
    keyed = rows.withColumn("doc", F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)))
    again = keyed.groupBy("doc").count().where("count > 1").select("doc")
    half = lambda k: F.when(F.col("_bit"), F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 16 * k + 1, 16), 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))
    return with_bit(keyed, again, ["doc"]).withColumn("hi", half(0)).withColumn("lo", half(1)).drop("_bit")


def with_fields(rows: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in fields)])
