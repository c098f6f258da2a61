"""Training-set building: splits, caps, samples, merges. Random order is an md5 of seed and key, so it is the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def cap_per_group(rows: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, in random order; Spark filters ranks before the shuffle too."""
    w = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def ranked(rows: DataFrame, by: list[str], key: str, seed: int = 42, digits: int = 3) -> DataFrame:
    """rows with `rank`, their place from 1 in the random order of their group, and `n`, the group's rows.

    Rows are ranked within the first `digits` of their draw, 16**digits parts a group, and a histogram of those parts gives what stands before
    each: no group is sorted by one task. Null is a group like others.
    """
    drawn = rows.withColumn("_draw", draw(key, seed)).withColumn("_part", F.left("_draw", F.lit(digits)))
    parts = drawn.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_c").over(group).alias("n"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_draw", key))
    return drawn.withColumn("_place", place).join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_place")).alias("rank"), "n")


def _split(train: float, val: float, test: str = "test") -> Column:
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    return F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise(test)


def group_split(rows: DataFrame, group: str, train: float = 0.85, val: float = 0.10, seed: int = 42) -> DataFrame:
    """rows with `split`: whole groups go to train, val or test by their share of the number of groups."""
    ids = ranked(rows.select(group).distinct(), [], group, seed)
    return rows.join(ids.select(group, _split(train, val).alias("split")), group)


def simple_split(rows: DataFrame, key: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with `split`, by share of all rows."""
    return ranked(rows, [], key, seed).withColumn("split", _split(train, val)).drop("rank", "n")


def ratio_split(rows: DataFrame, cls: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42, most: int | None = None) -> DataFrame:
    """rows with `split`, by share of each class; of a class at most `most` train, the first in random order."""
    out = ranked(rows, [cls], key, seed).withColumn("split", _split(train, val))
    out = out if most is None else out.where((F.col("split") != "train") | (F.col("rank") <= most))
    return out.drop("rank", "n")


def stratified(rows: DataFrame, strata: list[str], key: str, target: int, least: int = 1, seed: int = 42, top_up: bool = False) -> DataFrame:
    """About `target` rows: a floor of `least` of each stratum, the rest in proportion (rounded half to even), trimmed to the target, optionally topped up to it.

    No stratum gives more than max(target, least) rows, so ranks beyond that go before the shuffle; sizes are summed apart.
    """
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(draw(key, seed), key))).where(F.col("rank") <= max(target, least))
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))  # one row
    sizes = sizes.join(F.broadcast(total)).select(*(F.col(c).alias(f"_{c}") for c in strata), F.greatest(F.lit(least), F.bround(F.col("n") * target / F.col("all"), 0).cast("int")).alias("quota"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    chosen = some.join(sizes, same).withColumn("extra", F.col("rank") > F.col("quota"))
    chosen = chosen if top_up else chosen.where(~F.col("extra"))
    return chosen.orderBy("extra", "rank", draw(key, seed), key).limit(target).select(*rows.columns)


def negatives(rows: DataFrame, positive: Column, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """All positive rows, and of the others floor(ratio * positives) in random order."""
    marked = rows.withColumn("_pos", positive)
    n = marked.agg(F.floor(F.count_if("_pos") * ratio).alias("_want"))  # one row
    out = ranked(marked, ["_pos"], key, seed).join(F.broadcast(n)).where(F.col("_pos") | (F.col("rank") <= F.col("_want")))
    return out.select(*rows.columns, F.col("_pos").alias("positive"))


def head_per_type(rows: DataFrame, cls: str, order: str, want: int) -> DataFrame:
    """Of each class the first max(1, want // classes) rows in order, `want` in all, classes by name."""
    k = rows.agg(F.greatest(F.lit(1), F.floor(F.lit(want) / F.countDistinct(cls))).alias("_k"))  # one row
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(order))).where(F.col("_r") <= want)
    return first.join(F.broadcast(k)).where("_r <= _k").orderBy(cls, order).limit(want).select(*rows.columns)


def quota_sample(rows: DataFrame, cls: str, level: str, key: str, paper: str, quotas: dict[str, dict[str, int]], presample: int = 200, seed: int = 42) -> DataFrame:
    """A small set by quotas of class and level: of a class's `presample` first rows in random order those of the level, new papers first; where a level is empty, any of the class.

    Only the presample, classes times `presample` rows, reaches the driver: each choice depends on the papers chosen before.
    """
    some = rows.where(F.col(cls).isin(*quotas)).withColumn("_d", draw(key, seed)).withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy("_d", key))).where(F.col("_r") <= presample)
    pool = [r.asDict() for r in some.orderBy(cls, "_r").select(cls, level, key, paper).collect()]
    used, chosen = set(), []
    for c, by_level in quotas.items():
        left = [r for r in pool if r[cls] == c]
        for name, count in by_level.items():
            matching = [r for r in left if r[level] == name] or list(left)
            fresh = [r for r in matching if r[paper] not in used]
            taken = matching if len(matching) <= count else [*fresh, *(r for r in matching if r[paper] in used)][:count]
            if len(matching) > count:
                used |= {r[paper] for r in taken if r in fresh}
            chosen += [(r[key], c, name, k) for k, r in enumerate(taken)]
            ids = {r[key] for r in taken}
            left = [r for r in left if r[key] not in ids]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.sparkSession.createDataFrame(chosen, f"{key} {kinds[key]}, {cls} string, wanted string, place int")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the latest by order."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("x")).select("x.*")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and all rows of new whose key old lacks, repeated keys of new included."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def test_rows(rows: DataFrame, key: str, most: int = 0, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """The rows of a test set: all, if `most` is 0 or no fewer are there; else `most` of them, in proportion to strata where there are any, in random order."""
    if most <= 0 or rows.select(key).limit(most + 1).count() <= most:
        return rows
    if strata:
        return stratified(rows, strata, key, most, seed=seed)
    return rows.orderBy(draw(key, seed), key).limit(most)
