"""Ordered events: job states, expiry, rate windows, provider fallback, sessions; all by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The state that an event type leads to.
STATES = {"signup": "queued", "view": "processing", "click": "processing", "purchase": "completed", "error": "failed"}


def state_of(event_type: str):
    out = None
    for k, v in STATES.items():
        out = F.when(F.col(event_type) == k, v) if out is None else out.when(F.col(event_type) == k, v)
    return out.otherwise("unknown")


def latest_state(events: DataFrame, job: str) -> DataFrame:
    """The state of each job after its last event, and how many events led there; partly summed before the shuffle."""
    last = F.max_by(F.struct("event_type", "ts", "event_id"), F.struct("ts", "event_id"))
    by = events.groupBy(job).agg(last.alias("e"), F.count("*").alias("events"))
    return by.select(job, state_of("e.event_type").alias("state"), F.col("e.event_id").alias("last_event"), "events")


def unexpired(events: DataFrame, job: str, seconds: int) -> DataFrame:
    """Jobs whose last event is no more than `seconds` before the last of all."""
    by = events.groupBy(job).agg(F.max("ts").alias("last"))
    end = events.agg(F.max("ts").alias("end"))  # one row
    return by.join(F.broadcast(end)).where(F.expr(f"last >= end - INTERVAL {seconds} SECONDS")).select(job, "last")


def rate_window(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Requests and their sum within `seconds` up to and with each event of a key.

    A key's events are dealt over spans of that length, each event standing in the next span too, so that a busy key isn't one group.
    """
    width = seconds * 1_000_000
    timed = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("own", F.floor(F.col("t") / width).cast("long"))
    dealt = timed.withColumn("span", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = Window.partitionBy(key, "span").orderBy("t").rangeBetween(-width, 0)
    out = dealt.withColumn("requests", F.count("*").over(w)).withColumn("total", F.round(F.sum("value").over(w), 6))
    return out.where("span = own").select("event_id", key, "requests", "total")


def running(rows: DataFrame, key: str, place, width: int, order: list[str], sums: dict) -> DataFrame:
    """rows with running sums (name: column) of each key in an order that begins with `place`, a whole number.

    A key's rows are dealt over spans of `width` places; sums within a span are carried on by those of the spans before, so
    that a busy key isn't one group: what is summed over the whole key is one row a span.
    """
    spanned = rows.withColumn("_span", F.floor(place / width).cast("long"))
    inside = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spanned.groupBy(key, "_span").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    carried = spans.select(key, "_span", *(F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums))
    own = spanned.select("*", *(F.sum(c).over(inside).alias(f"_o_{n}") for n, c in sums.items()))
    joined = own.join(carried, [key, "_span"])
    return joined.select(*rows.columns, *((F.col(f"_o_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums))


def running_mean(events: DataFrame, key: str, seconds: int = 3600) -> DataFrame:
    """How many events of a key there were up to each, and the mean of their values; a null value counts for n alone."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    sums = {"n": F.lit(1), "_sum": F.coalesce("value", F.lit(0.0)), "_known": F.col("value").isNotNull().cast("long")}
    out = running(events.select("event_id", key, "ts", "value"), key, at, seconds * 1_000_000, ["ts", "event_id"], sums)
    return out.select("event_id", key, F.col("n").cast("int").alias("n"), F.round(F.try_divide("_sum", "_known"), 9).alias("mean"))


def fallback(attempts: DataFrame, least: float = 0.7) -> DataFrame:
    """Of each request's attempts (request_id, chain_pos, provider, healthy, success, confidence) the first healthy, successful and sure one; else a success at the chain's end; else none."""
    w = Window.partitionBy("request_id")
    a = attempts.withColumn("last", F.max("chain_pos").over(w))
    ok = F.col("healthy") & F.col("success") & ((F.col("confidence") >= least) | (F.col("chain_pos") == F.col("last")))
    by = a.groupBy("request_id").agg(F.min_by("provider", F.when(ok, F.col("chain_pos"))).alias("provider"), F.count_if(ok).alias("accepted"), F.count("*").alias("attempts"))
    return by.select("request_id", F.when(F.col("accepted") > 0, F.col("provider")).alias("provider"), "attempts", F.when(F.col("accepted") > 0, "answered").otherwise("exhausted").alias("outcome"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    by = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select(key, F.col("w.start").alias("start"), "n")
