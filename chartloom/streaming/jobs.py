"""Structured Streaming over events: windows with watermarks, job state with expiry, and idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each tumbling window and type; state goes once the watermark has passed the window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def job_states(events: DataFrame, expiry: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(user_id, event_type, events) after each batch: the last event of each job by time, dropped once the watermark is `expiry` past it."""
    ms = int(pd.Timedelta(expiry).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, kind, n = state.get if state.exists else (0, "", 0)
        for b in batches:
            n += len(b)
            last = b.micros.idxmax()
            if b.micros[last] >= at:
                at, kind = int(b.micros[last]), b.event_type[last]
        state.update((at, kind, n))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "events": [n]})

    timed = events.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, events long", "at long, kind string, n long", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(path: str, key: str, order: str | None = None):
    """A foreachBatch writer that keeps one row of each key, the newest by `order` (a batch without one has a row a key, else of repeated keys the last by all columns); a batch that comes again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != key]
        newest = F.max_by(F.struct(*rest), F.struct(order, *rest)) if order else F.max(F.struct(*rest))
        batch.groupBy(key).agg(newest.alias("x")).select(key, "x.*").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest_of(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What an upsert_sink holds: of each key the row of the last epoch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/*")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "epoch").alias("x")).select(key, "x.*")
