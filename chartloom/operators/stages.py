"""What can be plugged in: adapters by stage and name, stages over DataFrames with a fallback, parsers, suites, engines."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Things by stage and name, names in any case."""

    def __init__(self):
        self._of: dict[tuple[str, str], object] = {}

    def register(self, stage: str, name: str) -> Callable:
        def keep(thing):
            if (key := (stage, name.lower())) in self._of:
                raise ValueError(f"{name} is registered for {stage} already")
            self._of[key] = thing
            return thing

        return keep

    def resolve(self, stage: str, name: str):
        if (stage, name.lower()) not in self._of:
            raise ValueError(f"unknown {stage} {name!r}; known: {', '.join(self.names(stage)) or 'none'}")
        return self._of[stage, name.lower()]

    def is_registered(self, stage: str, name: str) -> bool:
        return (stage, name.lower()) in self._of

    def names(self, stage: str) -> list[str]:
        return sorted(n for s, n in self._of if s == stage)


REGISTRY = Registry()


class Stage(ABC):
    """A step from DataFrame to DataFrame: rows that don't pass `valid` take `fallback`, others `process`; both give the same columns."""

    @abstractmethod
    def process(self, rows: DataFrame) -> DataFrame: ...

    @abstractmethod
    def fallback(self, rows: DataFrame) -> DataFrame: ...

    def valid(self):
        return F.lit(True)

    def __call__(self, rows: DataFrame) -> DataFrame:
        ok = F.coalesce(self.valid(), F.lit(False))
        return self.process(rows.where(ok)).unionByName(self.fallback(rows.where(~ok)))


class Parser(ABC):
    """Documents (path, length, ...) into rows of pages; `extensions` says which it reads."""

    extensions: tuple[str, ...] = ()

    @abstractmethod
    def pages(self, files: DataFrame) -> DataFrame: ...


class Engine(ABC):
    """Requests (request_id, task, prompt) into answers (request_id, answer, confidence)."""

    @abstractmethod
    def answers(self, requests: DataFrame) -> DataFrame: ...


@REGISTRY.register("detection", "mock")
class MockDetector(Stage):
    """Made-up boxes of each image (image_id, width, height), from its id alone: the same on every run; images without a size have none."""

    def __init__(self, boxes: int = 2):
        self.boxes = boxes

    def valid(self):
        return (F.col("width") > 0) & (F.col("height") > 0)

    def process(self, rows: DataFrame) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(self.boxes - 1)))
        part = lambda n, of: F.pmod(F.col("image_id") * (7 + n) + F.col("k") * (13 + n), of)
        r = rows.select("image_id", "width", "height", k.alias("k"))
        r = r.withColumn("x0", part(0, F.col("width"))).withColumn("y0", part(4, F.col("height")))
        return r.select("image_id", F.col("k").alias("box"), "x0", "y0", F.least("width", F.col("x0") + 100).alias("x1"), F.least("height", F.col("y0") + 80).alias("y1"), F.round(0.9 - 0.1 * F.col("k"), 6).alias("confidence"))

    def fallback(self, rows: DataFrame) -> DataFrame:
        none = F.lit(None)
        return rows.select("image_id", F.lit(-1).alias("box"), *(none.cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(0.0).alias("confidence"))


@REGISTRY.register("engine", "rules")
class RuleEngine(Engine):
    """Answers by fixed rules: what no rule knows is unsure."""

    def answers(self, requests: DataFrame) -> DataFrame:
        known = F.when(F.col("task") == "describe", F.concat(F.lit("A chart: "), F.col("prompt"))).when(F.col("task") == "count", F.length("prompt").cast("string"))
        return requests.select("request_id", F.coalesce(known, F.lit("")).alias("answer"), F.when(known.isNotNull(), 0.8).otherwise(0.0).alias("confidence"))


@REGISTRY.register("engine", "echo")
class EchoEngine(Engine):
    """Answers with the prompt, half sure."""

    def answers(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id", F.col("prompt").alias("answer"), F.lit(0.5).alias("confidence"))


def routed(requests: DataFrame, chain: list[str], least: float = 0.7) -> DataFrame:
    """Each request's answer by the first engine of the chain that is sure enough, else by the last; engines see only what those before left."""
    out, left = None, requests
    for k, name in enumerate(chain):
        a = left.join(REGISTRY.resolve("engine", name)().answers(left), "request_id").withColumn("engine", F.lit(name))
        done = a if k == len(chain) - 1 else a.where(F.col("confidence") >= least)
        out = done if out is None else out.unionByName(done)
        left = a.where(F.col("confidence") < least).select(*requests.columns)
    return out.select("request_id", "engine", "answer", "confidence")
