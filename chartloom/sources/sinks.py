"""Sinks: several forms of one result side by side, one text a key, merged datasets, metric logs, schemas."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.sources.files import contents, dispatched, extension, listed, opened, parser_of, put

#: A JSON Schema type for each Spark type that has one.
JSON_TYPES = {T.StringType: "string", T.BooleanType: "boolean", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.DoubleType: "number", T.FloatType: "number", T.DateType: "string", T.TimestampType: "string"}


def fan_out(forms: dict[str, tuple[DataFrame, Callable[[DataFrame, str], None]] | None], folder: str) -> dict[str, str]:
    """Write each form (name: rows and their writer) below a folder, none where it is None; one that fails leaves the others alone. What became of each."""
    said = {}
    for name, form in forms.items():
        if form is None:
            said[name] = "skipped"
            continue
        rows, write = form
        try:
            write(rows, f"{folder}/{name}")
            said[name] = "written"
        except Exception as e:  # a sink's failure is its own
            said[name] = f"failed: {type(e).__name__}"
    return said


def as_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def as_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("emptyValue", "").csv(path)


def as_text(column: str) -> Callable[[DataFrame, str], None]:
    return lambda rows, path: rows.select(column).write.text(path)


def text_each(rows: DataFrame, folder: str, kind: str, key: str, text: str) -> None:
    """One file for each key under its kind: kind=.../key=.../, a line for each of its rows, written and moved by executors."""

    def run(batches):
        fs, root = opened(folder)
        now, out, beside, above = None, None, None, None

        def close():
            out.close()
            fs.move(beside, f"{above}/part.txt")

        for b in batches:
            for *path, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != now:
                    if out is not None:
                        close()
                    now, above = path, "/".join((root, *(f"{c}={_escaped(x)}" for c, x in zip((kind, key), path, strict=True))))
                    fs.create_dir(above, recursive=True)
                    out = fs.open_output_stream(beside := f"{above}/.part.{uuid4().hex[:8]}")
                out.write((line or "").encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
        if out is not None:
            close()

    by = rows.select(F.col(kind).cast("string"), F.col(key).cast("string"), F.col(text).cast("string"))
    by.repartition(kind, key).sortWithinPartitions(kind, key).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


#: What stands for null in a folder's name, as Spark's own partitions have it.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def _escaped(value: str | None) -> str:
    """A value in a folder's name, as Spark's own partitions escape it."""
    return re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else NULL_NAME


def texts_of(spark: SparkSession, folder: str, kind: str, key: str) -> DataFrame:
    """(kind, key, value) of each line of the files that text_each wrote."""
    found = contents(listed(spark, folder))
    of = lambda c: F.regexp_extract("path", f"/{c}=([^/]*)/", 1)
    plain = lambda c: F.when(of(c) != NULL_NAME, F.url_decode(F.replace(of(c), F.lit("+"), F.lit("%2B")))).alias(c)
    lines = F.split(F.regexp_replace(F.col("content").cast("string"), "\n$", ""), "\r\n|\r|\n")
    return found.select(plain(kind), plain(key), F.explode(lines).alias("value"))


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (path, content), below a folder and by executors, each first beside its place and then moved, so that no reader sees half of one and a task that runs again changes nothing.

    Paths are those that pyarrow's file systems open: local and shared mounts, and stores with a URI.
    """

    def run(batches):
        fs, root = opened(folder)
        made = set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                above, name = f"{root}/{path}".rsplit("/", 1)
                if above not in made:
                    fs.create_dir(above, recursive=True)
                    made.add(above)
                beside = f"{above}/.{name}.{uuid4().hex[:8]}"
                with fs.open_output_stream(beside) as out:
                    out.write(content.as_py() or b"")
                fs.move(beside, f"{above}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def uploads(spark: SparkSession, folder: str, target: str, most_bytes: int) -> DataFrame:
    """Take the files of a folder over into a target, each under the MD5 of its path with its extension, in the folder of the MD5's first two digits: (path, saved, status, error).

    Files of another extension are refused (400), larger ones too (413); their contents are never read. Executors copy the others (200), and
    a copy is there whole or not at all.
    """
    said = dispatched(listed(spark, folder), most_bytes=most_bytes)
    name = F.concat(F.md5(F.regexp_replace("path", "^file:/+", "/")), extension(F.col("path")))
    content = contents(listed(spark, folder).where(F.col("length") <= most_bytes).where(parser_of(F.col("path")).isNotNull()))
    write_files(content.select(F.concat(F.substring(name, 1, 2), F.lit("/"), name).alias("path"), "content"), target)
    status = F.when(F.col("parser").isNull(), 400).when(F.col("error").isNotNull(), 413).otherwise(200)
    return said.select("path", F.when(F.col("error").isNull(), name).alias("saved"), status.alias("status"), "error")


def merged_dataset(rows: DataFrame, count: str) -> DataFrame:
    """One row: how many files and entries there are in all, and how many by chart type, as JSON."""
    by = rows.groupBy("chart_type").agg(F.count("*").alias("files"), F.sum(count).alias("entries"))
    return by.agg(F.sum("files").alias("files"), F.sum("entries").alias("entries"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chart_type", "entries"))))).alias("by_type"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Rows of metrics added to a log, partitioned by run; a log is never rewritten."""
    rows.write.mode("append").partitionBy("run_id").json(path)


def save_json(spark: SparkSession, folder: str, name: str, value) -> None:
    """A small value as a JSON file that appears whole or not at all."""
    put(spark, folder, {name: json.dumps(value, ensure_ascii=False, indent=2)})


def json_schema(kind: T.DataType) -> dict:
    """A Spark type as JSON Schema; null is allowed where the type allows it."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": JSON_TYPES.get(type(kind), "string")}
