"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are word arrays. Of every `window` - `gram` + 1 consecutive word grams the one of least hash is
kept as a fingerprint with its position, so any shared span of `window` words shares a fingerprint. The
fingerprints of documents meet those of the benchmark; a meeting fixes how item and document align, and
along that alignment all windows that are equal word for word are the hits. Items of fewer words than a
window are one window of their own length and are proposed by the hash of that whole sequence.

A fingerprint that an item has in more than PLACES places, or an item that would align in more than SHIFTS ways, as
repetitive words do, proposes the item without alignment: then the document's windows are held against the set of the item's,
so no pair of places is ever counted out.

Nothing is sampled or capped: fingerprints only propose, words decide. Up to BROADCAST_ROWS fingerprints, each a key, an
item's number and PLACES places at most, are broadcast; items' words meet the proposed pairs alone. Proposals of few documents are broadcast
by the words they carry, so that texts are not shuffled; beyond that bound they are joined by a shuffle.

A null text has no words. Rows that repeat a doc_id, or have none, are told apart by their texts (`labelled.named`), so each
meets its own proposals only; very long texts are judged whole. Items without words never occur; an item without item_id marks words but isn't listed. An empty table of
documents gives an empty result, an empty benchmark no hits. Other columns, whatever their names, are carried in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.graph import cut
from chartloom.llm.labelled import ROW, as_rows, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower case; A-Z themselves are split off before they are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Low bits of a fingerprint that hold its position.
POSITION_BITS = 28
#: Benchmarks of up to so many fingerprints (some 80 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 400_000
#: Proposals are broadcast if they carry up to so many words of items (some 20 bytes each) in all.
BROADCAST_WORDS = 2_000_000
#: Places of one fingerprint in an item, and alignments of an item with a document, that are tried one by one.
PLACES, SHIFTS = 8, 256


def word_array(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # lower() would change letters beyond A-Z
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS), "")


def _up_to(last: Column, of) -> Column:
    """of(i) for i from 0 to last; empty if last is negative."""
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), of)).otherwise(F.array().cast("array<long>"))


def fingerprints(words: str, gram: int, window: int) -> Column:
    """Winnowed fingerprints: hash in the high bits, position in the low ones."""
    w = F.col(words)
    grams = _up_to(F.size(w) - gram, lambda i: F.shiftleft(F.xxhash64(*(F.get(w, i + k) for k in range(gram))), POSITION_BITS).bitwiseOR(i.cast("long")))
    span = window - gram + 1
    return F.when(
        F.size(w) >= window,
        F.array_distinct(F.flatten(F.transform(F.array(grams), lambda h: _up_to(F.size(h) - span, lambda i: F.least(*(F.get(h, i + k) for k in range(span))))))),
    ).otherwise(F.array().cast("array<long>"))


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is proven small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """(row, n_words, n_hit, item_ids, contaminated): each row of docs, with all its columns, as a struct;
    item_ids are sorted as strings.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("iw")).where("size(iw) > 0").distinct()
    items = cut(items.withColumn("no", F.monotonically_increasing_id()))
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    split = lambda df, keep: df.select(*keep, F.shiftright("fp", POSITION_BITS).alias("key"), F.col("fp").bitwiseAND(low).cast("int").alias("at"))

    theirs = split(items.where(F.size("iw") >= window).select("no", F.explode(fingerprints("iw", gram, window)).alias("fp")), ["no"])
    theirs = theirs.groupBy("key", "no").agg(F.collect_list("at").alias("places")).select("key", "no", F.when(F.size("places") <= PLACES, F.col("places")).alias("places"))
    rows = named(as_rows(docs), F.col("row.doc_id"), F.col("row.text"))
    worded = rows.select(*ROW, word_array(F.col("row.text")).alias("w"))
    ours = split(worded.select(*ROW, F.explode(fingerprints("w", gram, window)).alias("fp")), ROW)
    proposed = ours.join(_small(theirs), "key").select(*ROW, "no", "at", F.explode_outer("places").alias("iat")).select(*ROW, "no", (F.col("at") - F.col("iat")).alias("shift"))
    lengths = sorted(r[0] for r in items.where(F.size("iw") < window).select(F.size("iw")).distinct().collect())  # fewer than window
    if lengths:  # one pass over all lengths: the key of a sequence is the hash of its length and words
        sequence = lambda xs, i, n: F.xxhash64(F.lit(n), *(F.get(xs, i + k) for k in range(n)))
        whole = F.coalesce(*(F.when(F.size("iw") == n, sequence(F.col("iw"), F.lit(0), n)) for n in lengths))
        short = items.where(F.size("iw") < window).select("no", whole.alias("key"))
        of_length = lambda n: _up_to(F.size("w") - n, lambda i: sequence(F.col("w"), i, n))
        every = F.concat(*map(of_length, lengths))
        seen = worded.select(*ROW, F.explode(F.array_distinct(every)).alias("key"))
        proposed = proposed.union(seen.join(_small(short), "key").select(*ROW, "no", F.lit(None).cast("int").alias("shift")))
    pairs = proposed.groupBy(*ROW, "no").agg(F.collect_set("shift").alias("shifts"), F.bool_or(F.col("shift").isNull()).alias("free"))
    pairs = pairs.select(*ROW, "no", F.when(~F.col("free") & (F.size("shifts") <= SHIFTS), F.col("shifts")).alias("shifts"))
    found = cut(pairs.join(items, "no").groupBy(*ROW).agg(F.collect_list(F.struct("item", "iw", "shifts")).alias("found")))
    carried = found.agg(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + F.size(x["iw"]) + 4))).head()[0] or 0
    met = rows.join(F.broadcast(found) if carried <= BROADCAST_WORDS else found, ROW, "left").withColumn("words", word_array(F.col("row.text")))
    w = F.col("words")

    def places(of: Column, length: Column | int) -> Column:
        """From 0 to the last start of a span of that length."""
        last = F.size(of) - length
        return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def starts(x: Column) -> Column:
        """Spans of the document that equal a window of a proposed item."""
        iw, m = x["iw"], F.size(x["iw"])

        def along(shift: Column) -> Column:
            a, b = F.greatest(F.lit(0), -shift), F.least(m, F.size(w) - shift) - window
            equal = lambda j: F.slice(w, shift + j + 1, window) == F.slice(iw, j + 1, window)
            return F.transform(F.filter(F.when(b >= a, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>")), equal), lambda j: F.struct((j + shift).alias("a"), (j + shift + window).alias("b")))

        text = lambda xs, i: F.array_join(F.slice(xs, i + 1, window), " ")
        both = F.array_intersect(F.transform(places(w, window), lambda i: text(w, i)), F.transform(places(iw, window), lambda i: text(iw, i)))
        windows = F.transform(F.filter(places(w, window), lambda i: F.array_contains(both, text(w, i))), lambda i: F.struct(i.alias("a"), (i + window).alias("b")))
        whole = F.transform(F.filter(places(w, m), lambda i: F.slice(w, i + 1, m) == iw), lambda i: F.struct(i.alias("a"), (i + m).alias("b")))
        return F.when(x["shifts"].isNotNull(), F.flatten(F.transform(x["shifts"], along))).when(m < window, whole).otherwise(windows)

    hits = F.filter(F.transform("found", lambda x: F.struct(x["item"].alias("item"), starts(x).alias("spans"))), lambda x: F.size(x["spans"]) > 0)
    met = met.withColumn("hits", F.when(F.col("found").isNotNull(), hits))
    spans = F.array_sort(F.array_distinct(F.flatten(F.col("hits.spans"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return (
        met.withColumn("n_words", F.size(w).cast("long"))
        .withColumn("n_hit", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("item_ids", F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.col("hits.item")))), F.array().cast("array<string>")))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select("row", "n_words", "n_hit", "item_ids", "contaminated")
    )
