"""Progress of streams as rows: what each micro-batch read and what was observed in it."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from chartloom.sources.files import put

#: A row for each metric of a micro-batch; `metrics` is its observed numbers as JSON, since streams observe different ones.
ROWS = "query string, batch long, at string, rows long, seconds double, metrics string"


def observed(stream: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """The stream, whose micro-batches report these aggregates under a name."""
    return stream.observe(name, *metrics)


class MetricLog(StreamingQueryListener):
    """Writes a JSON line for each finished micro-batch into a folder, each first beside its place and then renamed, so that a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str, query: str | None = None):
        self.spark, self.folder, self.query = spark, folder, query

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        if self.query is not None and p.name != self.query:
            return
        metrics = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        line = {"query": p.name or str(p.id), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "metrics": json.dumps(metrics)}
        put(self.spark, self.folder, {f"batch-{p.batchId:09d}-{uuid4().hex[:8]}.json": json.dumps(line)})

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(query, batch, at, rows, seconds, metrics) of what a MetricLog has written; a batch that was reported again, with its last report."""
    from pyspark.sql import functions as F

    found = spark.read.schema(ROWS).json(folder)
    return found.groupBy("query", "batch").agg(F.max_by(F.struct("at", "rows", "seconds", "metrics"), "at").alias("x")).select("query", "batch", "x.*")


def drained(spark: SparkSession, seconds: int = 60) -> None:
    """Wait until listeners have seen what has ended so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(seconds * 1000)
