"""Exact deduplication by an extendible-hash index, in DataFrame functions alone.

Two texts are equal when they are the same once every run of ASCII white space is one space. A text's key is a 64-bit
hash; equal keys with different SHA-256 digests are chained under their key. The directory of the index begins as one bucket; a bucket
with more than `capacity` keys is split by the next bit of the key, so the directory doubles where it must and nowhere
else. Counts of a level of LEVEL bits come from one pass over the keys of the buckets that are still overfull. Each bucket
is a contiguous range of keys and belongs to one owner task, which sorts its chains and writes them to the shared folder.

Digests name chain entries, bytes decide: the texts of every key that occurs more than once are compared as grouping
keys, which Spark compares byte by byte, once a task and text before the shuffle. Should one digest stand for two texts,
the rows under it are grouped by their texts instead. Rows, copies included, are counted before any shuffle; what
is joined back are a few numbers a row, and a hot key is split by adaptive execution, so no group meets in one task.

A null text counts as empty; empty texts are equal to each other, and a text of white space alone to one space. Of equal
texts the row with the smallest doc_id stays; a null doc_id counts as larger than all others. Of rows that repeat
both id and text exactly one stays. Very long texts are hashed and compared whole; an empty table gives an empty result. Other
columns, whatever their names, are ignored by exact_groups() and carried by kept_rows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.graph import Scratch, cut, likely
from chartloom.llm.labelled import as_rows

SPACE = r"[\x20\x09-\x0D]+"
#: Keys that a bucket holds before it splits: some 60 bytes each.
CAPACITY = 100_000
#: Bits of the key that one pass counts.
LEVEL = 8
#: Directories of up to so many buckets (three numbers each) are broadcast to those who look up keys; larger ones are shuffled.
BROADCAST_BUCKETS = 200_000


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_key(text: Column, bits: int = 64) -> Column:
    """The first `bits` bits of a text's hash, in the high bits of a long."""
    h = F.xxhash64(text)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def prefix(key: Column | str, depth: int) -> Column:
    """The first `depth` bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, level: int = LEVEL) -> DataFrame:
    """(depth, prefix, n): the buckets of different keys (key long); each holds the n keys that begin with `prefix`, at most `capacity`.

    Keys differ within 64 bits, so every bucket of two or more keys can be split.
    """
    scratch, base, parts, over = Scratch(), 0, [], None
    while True:
        top = min(base + level, 64)
        inside = keys if over is None else keys.withColumn("_at", prefix("key", base)).join(over, "_at", "left_semi")
        cells = inside.groupBy(prefix("key", top).alias("cell")).agg(F.count("*").alias("n"))
        held = lambda d: F.sum("n").over(Window.partitionBy(F.shiftrightunsigned("cell", top - d)))  # noqa: E731, B023
        for d in range(0 if over is None else base + 1, top + 1):
            cells = cells.withColumn(f"n{d}", held(d))
        depths = range(0 if over is None else base + 1, top + 1)
        fits = F.coalesce(*(F.when(F.col(f"n{d}") <= capacity, F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("cell", top - d).alias("prefix"), F.col(f"n{d}").alias("n"))) for d in depths))
        cells = cut(cells.select("cell", fits.alias("bucket")))
        parts.append(cells.where("bucket IS NOT NULL").select("bucket.*").distinct())
        over = cut(cells.where("bucket IS NULL").select(F.col("cell").alias("_at")), scratch)
        if top == 64 or not over.head(1):
            break
        base = top
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_buckets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (key, ...) with the depth and prefix of the one bucket that holds their key."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect()) or [0]  # 65 numbers at most
    looked = rows.withColumn("_at", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix("key", d).alias("prefix")) for d in depths))))
    few = buckets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    side = buckets.select(F.struct("depth", "prefix").alias("_at"))
    return looked.join(F.broadcast(side) if few else side, "_at").select(*rows.columns, "_at.depth", "_at.prefix")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64, digest_bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text, ...).

    key_bits and digest_bits shorten keys and the digests that name chain entries; results stay the same.
    """
    text = normalised(F.col("text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sha = F.sha2("text", 256)
    rows = cut(plain.select("doc_id", text_key(F.col("text"), key_bits).alias("key"), F.unhex(sha).alias("sha"), F.monotonically_increasing_id().alias("rid")))
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bits // 8))
    chains = rows.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    chains = cut(chains.select("key", "digest", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid")))
    buckets = cut(directory(chains.select("key").distinct(), capacity))
    index = cut(with_buckets(chains, buckets).repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "key", "keep_id", "digest"))

    twice = index.where("n > 1").select("key").distinct()
    texts = likely(plain.withColumn("key", text_key(F.col("text"), key_bits)), twice, ["key"]).groupBy("key", "text").agg(F.count("*").alias("n"))
    clash = cut(texts.groupBy("key", F.substring(F.unhex(sha), 1, digest_bits // 8).alias("digest")).agg(F.count("*").alias("texts")).where("texts > 1").select("key", "digest"))
    entry = index.select("key", "digest", "n", "keep_id", "keep_rid")
    if clash.head(1):
        entry = entry.join(clash, ["key", "digest"], "left_anti")
    found = rows.join(entry, ["key", "digest"]).select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return found.unionByName(_by_text(plain, clash, key_bits, digest_bits)) if clash.head(1) else found


def _by_text(plain: DataFrame, clash: DataFrame, key_bits: int, digest_bits: int) -> DataFrame:
    """The result for the rows under (key, digest) pairs that stand for several texts."""
    sha = F.sha2("text", 256)
    keyed = plain.withColumn("key", text_key(F.col("text"), key_bits)).withColumn("digest", F.substring(F.unhex(sha), 1, digest_bits // 8))
    rows = cut(likely(keyed, clash, ["key", "digest"]).join(clash, ["key", "digest"]).select("doc_id", "text", F.monotonically_increasing_id().alias("rid")))
    first = rows.groupBy("text").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    return rows.join(first, "text").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), sha.alias("text_sha256"))


def kept_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs without the rows that exact_groups() drops, with all their columns; of rows that repeat id and text any one stays."""
    kept = exact_groups(docs, capacity).where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    keyed = as_rows(docs).withColumn("sha", F.unhex(F.sha2(normalised(F.col("row.text")), 256))).withColumn("id", F.col("row.doc_id").cast("long"))
    met = keyed.join(kept, (F.col("sha") == F.col("_sha")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return met.dropDuplicates(["id", "sha"]).select("row.*")
