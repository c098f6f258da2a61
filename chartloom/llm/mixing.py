"""Mixing sources to target weights, in DataFrame functions alone.

Words are summed per source; weights share all words over the sources, no source above `most` times its
own size, what exceeds that being shared again by weight. The level at which weights meet those limits
is found in closed form over the table of sources. A source's rate is its target over its size; each
document is taken floor(rate) times, and once more if a hash of its id, seeded, falls below the
fraction. Of `seeds` seeds each source uses the one whose draw comes nearest its target; all draws are
summed in one pass, before any shuffle.

Texts are read twice: once for the sizes, which are kept in a table of three numbers a document from which
sources, targets and draws are summed, and once for the result.

The hash depends on doc_id alone (on the text where there is none), so reruns agree however data are
dealt. A null or empty text has size 0. Rows that repeat a doc_id are drawn alike. A null source is a
source, the last one. A source of size 0 has the target 0 and none of its documents is taken. Very long texts count
whole; an empty table gives an empty result. Other columns, whatever their names, are carried in the struct `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.graph import cut
from chartloom.llm.labelled import as_rows

#: Draws are numbers below this prime.
PRIME = 2**31 - 1


def seed_pair(k: int) -> tuple[int, int]:
    """Seed k: the two numbers of an affine hash modulo PRIME."""
    return pow(48271, 5 * k + 11, PRIME), pow(16807, 7 * k + 3, PRIME)


def text_size(text: Column) -> Column:
    """The number of words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _below(k: Column | int, part: Column, seeds: int = 0) -> Column:
    """Whether a document's draw under seed k is below part; k may be a column of numbers below seeds."""
    a, b = zip(*map(seed_pair, range(seeds) if seeds else [k]), strict=True)
    pick = lambda xs: F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), k + 1) if seeds else F.lit(xs[0]).cast("long")
    return F.pmod(F.col("own") * pick(a) + pick(b), F.lit(PRIME)) < part * PRIME


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    The windows run over the table of sources alone: a few rows per source name.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("all", F.sum("source_size").over(total).cast("double")).withColumn("cap", F.col("source_size").cast("double") * most).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    # with the limits up to this source reached, the others would stand at this level; the first one below the next limit is the level
    level = (F.col("all") - F.sum("cap").over(before)) / F.sum("weight").over(after)
    step = weighed.withColumn("level", level).withColumn("next", F.lead("at").over(order)).withColumn("none", F.col("all") / F.sum("weight").over(total)).withColumn("first", F.min("at").over(total))
    settled = F.min(F.when(F.col("level") <= F.col("next"), F.struct("at", "source", "level"))).over(total)["level"]
    line = F.when(F.col("none") <= F.col("first"), F.col("none")).otherwise(F.coalesce(settled, F.col("none")))
    return step.withColumn("line", line).select("source", "source_size", F.round(F.least("cap", F.col("line") * F.col("weight")), 6).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seeds: int = 32) -> DataFrame:
    """(row, size, source_size, target, copies, taken): each row of docs, with all its columns, as a struct; taken = copies * size."""
    own = F.conv(F.substring(F.md5(F.coalesce(F.col("row.doc_id").cast("string"), "row.text", F.lit(""))), 1, 7), 16, 10).cast("long")
    sized = as_rows(docs).select("row", "row.source", text_size(F.col("row.text")).alias("size"), own.alias("own"))
    thin = cut(sized.select("own", "size", "source"))
    targets = source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = cut(rates.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole")))
    drawn = _with_rates(thin, rates).groupBy("source").agg(F.first("target").alias("target"), F.first("whole").alias("whole"), F.sum("size").alias("source_size"), *(F.sum(F.when(_below(k, F.col("part")), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(seeds)))
    off = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]
    best = drawn.select("source", F.array_min(F.array(*off))["seed"].alias("seed"))
    plan = cut(rates.withColumnRenamed("source", "_s").join(best, F.col("_s").eqNullSafe(F.col("source"))).drop("_s"))
    copies = F.col("whole") + F.when(_below(F.col("seed"), F.col("part"), seeds), 1).otherwise(0)
    out = _with_rates(sized, plan).withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(0).cast("int"))
    return out.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Up to so many sources (some 60 bytes each) their table is broadcast; beyond, it is shuffled and skewed keys are split.
BROADCAST_SOURCES = 100_000


def _with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    few = rates.withColumnRenamed("source", "_s")
    if few.select("_s").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        few = F.broadcast(few)
    return docs.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: (row, copy), each row of docs as often as it is taken, with its number from 1."""
    return mix_plan(docs, weights, most).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
