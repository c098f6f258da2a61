"""Tables written to the folder that driver and executors share, so that plans are cut and lost executors lose none of them."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in the one that driver and executors share, as spark.checkpoint.dir names it; on one machine, as in tests, one of our own where none is set.

    It is erased when the application ends, with all tables that results were read from.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = sc.getCheckpointDir()
    path = f"{named.rstrip('/')}/tables-{sc.applicationId}"
    if path not in _owned:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _owned.add(path)
    return path


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """df, written as a table to the shared folder and read again: a lost executor loses none of it. Its shuffles' files are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        scratch.paths[id(out)] = (out, path)
    return out


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run inside free their shuffle files when they end; what they give must be written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of cut() that a later one supersedes."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def drop(self, *tables: DataFrame) -> None:
        """Erase tables that no plan reads any more."""
        for t in tables:
            df, path = self.paths.pop(id(t))
            erase(df.sparkSession, path)

    def clear(self) -> None:
        self.drop(*(df for df, _ in self.paths.values()))


#: Bytes of rows that reach a Python worker at once, whatever their number: long texts make batches of few rows.
BATCH_BYTES = 16 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have BATCH_BYTES at most from now on (plans run later, so the setting stays); a smaller setting is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", df.sparkSession.conf.get(name)) or 0) > BATCH_BYTES or not df.sparkSession.conf.get(name).rstrip("bB").isdigit():
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df
