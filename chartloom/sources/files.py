"""File sources: JSON records and inventories whose directory and name carry columns, and documents as pages."""

from __future__ import annotations

import os
import re
import tempfile
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chart types that a directory may name.
CHART_TYPES = ("area", "bar", "box", "heatmap", "histogram", "line", "pie", "scatter")


def path_parts(path):
    """(directory name, file stem) of a path column, of either separator."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_extract(clean, r"([^/]+)/[^/]+$", 1), F.regexp_extract(clean, r"([^/]+?)(\.[^./]*)?$", 1)


#: Which parser reads a file, by its extension.
PARSERS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".md": "markdown", ".markdown": "markdown", ".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image", ".tiff": "image", ".webp": "image"}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; on one machine, where none is set, a temporary one."""
    named = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="files-")
    return f"{named.rstrip('/')}/files-{uuid4().hex}"


def put(spark: SparkSession, folder: str, texts: dict[str, str | bytes]) -> None:
    """Write a few files through the file system that holds the folder, each first beside its place and then renamed, so that no reader sees half of one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name, text in texts.items():
        target = path(f"{folder}/{name}")
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        beside = path(target.getParent(), f".{target.getName()}.tmp")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode() if isinstance(text, str) else text))
        out.close()
        fs.delete(target, False)
        if not fs.rename(beside, target):
            raise OSError(f"could not write {target.toString()}")


def extension(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def parser_of(path):
    """The parser of a path's extension, null for others."""
    out = F.when(F.lit(False), F.lit(""))
    for e, p in PARSERS.items():
        out = out.when(extension(path) == e, p)
    return out


def dispatched(files: DataFrame, path: str = "path", most_bytes: int | None = None) -> DataFrame:
    """files (path, length) with their parser and, where one isn't read, why: its extension, or its size."""
    parser = parser_of(F.col(path))
    large = F.col("length") > most_bytes if most_bytes is not None else F.lit(False)
    return files.select("*", parser.alias("parser"), F.when(parser.isNull(), F.concat(F.lit("unsupported extension "), extension(F.col(path)))).when(large, "too large").alias("error"))


_stores: dict = {}


def opened(path: str):
    """(file system, path in it), as executors open it: local and shared mounts, and stores with a URI, each once a worker."""
    if not (uri := re.match(r"([a-z0-9]+):(//[^/]*)?(.*)", path)) or uri[1] == "file":
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    root = uri[1] + ":" + (uri[2] or "")
    if root not in _stores:
        _stores[root] = pafs.FileSystem.from_uri(root)
    fs, at = _stores[root]
    return fs, at.rstrip("/") + uri[3]


def _entries(fs, path: str):
    """(name, length, is it a folder) of what is in a folder, but for hidden names; no folder holds nothing. A local one's names are streamed."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            with os.scandir(path) as found:
                for e in found:
                    if not _hidden(e.name):
                        yield e.name, 0 if e.is_dir() else e.stat().st_size, e.is_dir()
        except (FileNotFoundError, NotADirectoryError):
            return
    else:
        for e in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if not _hidden(e.base_name):
                yield e.base_name, e.size or 0, e.type == pafs.FileType.Directory


def _file_size(fs, path: str) -> int | None:
    """The length of a file, none for a folder or what isn't there."""
    if isinstance(fs, pafs.LocalFileSystem):
        return os.path.getsize(path) if os.path.isfile(path) else None
    info = fs.get_file_info(path)
    return info.size if info.type == pafs.FileType.File else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over, too."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


_FOUND = "path string, length long, folder boolean"
#: Rows of a listing that leave a task at once.
LISTED_ROWS = 10_000


def _expanded(rows: DataFrame, named: str | None, last: bool = False) -> DataFrame:
    """rows (path, length, folder) with each folder replaced by what is in it under a name like `named`; the last one by all files below it."""

    def run(batches):
        out = []

        def batch():
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["path", "length", "folder"])

        for b in batches:
            for path, length, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not folder:
                    out.append((path, length, folder))
                    continue
                fs, at = opened(path)
                if (size := _file_size(fs, at)) is not None:  # what a glob names last may be a file
                    if named is None:
                        out.append((path, size, False))
                    continue
                todo = [""]
                while todo:
                    below = todo.pop()
                    for name, size, is_folder in _entries(fs, at + below):
                        if last and is_folder:
                            todo.append(f"{below}/{name}")
                        elif named is None or re.fullmatch(named, name):
                            out.append((f"{path}{below}/{name}", size, is_folder))
                        if len(out) >= LISTED_ROWS:
                            yield batch()
            yield batch()

    return rows.mapInArrow(run, _FOUND)


def _pattern(glob: str) -> str:
    """A part of a glob as a regular expression."""
    out, depth = "", 0
    for c in re.findall(r"\[[^\]]*\]|.", glob):
        depth += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else c if c.startswith("[") and len(c) > 1 else re.escape(c))
    return out


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length) of all files below a folder, or below the folders that a glob names; contents are not read. No folder is no file.

    Executors list: a folder at a time down to the second level below the glob, whose folders are then dealt over tasks, so that no names pass the driver.
    """
    parts = re.sub("^file:/+", "/", glob.rstrip("/")).split("/")
    fixed = next((k for k, x in enumerate(parts) if re.search(r"[*?\[{]", x)), len(parts))
    base = "/".join(parts[:fixed])
    now = spark.createDataFrame([(f"file:{base}" if base.startswith("/") else base, 0, True)], _FOUND)
    tasks = 2 * spark.sparkContext.defaultParallelism
    for x in parts[fixed:]:
        if re.search(r"[*?\[{]", x):
            now = _expanded(now, _pattern(x)).repartition(tasks)
        else:
            now = now.where("folder").select(F.concat("path", F.lit(f"/{x}")).alias("path"), "length", "folder")
    for _ in range(2):
        now = _expanded(now, None).repartition(tasks)
    return _expanded(now, None, True).where("NOT folder").select("path", "length")


#: Bytes of contents that leave a task at once.
CONTENT_BYTES = 16 << 20


def contents(files: DataFrame, most: int | None = None) -> DataFrame:
    """files (path, length) with their content, or the first bytes of it, read by executors; a file that has gone meanwhile is left out."""

    def run(batches):
        for b in batches:
            out, held = [], 0
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = opened(path)
                try:
                    with fs.open_input_file(at) as f:
                        x = f.read() if most is None else f.read(most)
                except FileNotFoundError:
                    continue
                out.append((path, length, x))
                held += len(x)
                if held >= CONTENT_BYTES:
                    yield _files(out)
                    out, held = [], 0
            yield _files(out)

    return files.select("path", "length").mapInArrow(run, "path string, length long, content binary")


def _files(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "length", "content"])


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height) of the images below a folder that begin as PNG or JPEG do; a PNG's size is in its header, and no more is read. Others are left out."""
    b = contents(listed(spark, folder).where(F.col("path").rlike(r"\.(png|jpg|jpeg|PNG|JPG|JPEG)$")), 24)
    head = F.hex("content")
    png, side = head.startswith("89504E470D0A1A0A"), lambda k: F.conv(F.substring(head, k, 8), 16, 10).cast("int")
    return b.where(png | head.startswith("FFD8FF")).select("path", F.when(png, side(33)).alias("width"), F.when(png, side(41)).alias("height"))


def manifest_ids(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(pos, chart_id) of a benchmark: the chart_ids of manifest.json, or, without them, the stems of annotations/*.json in order; optionally the first ones."""
    files = listed(spark, folder)
    named = [r["path"] for r in files.where("path LIKE '%/manifest.json'").collect()]  # one at most
    ids = spark.read.schema("chart_ids array<string>").option("multiLine", True).json(named[0]).where("size(chart_ids) > 0") if named else None
    if ids is not None and ids.head(1):
        out = ids.select(F.posexplode("chart_ids").alias("pos", "chart_id"))
    else:
        stems = files.where("path LIKE '%/annotations/%.json'").select(path_parts(F.col("path"))[1].alias("chart_id"))
        out = stems.select((F.row_number().over(Window.orderBy("chart_id")) - 1).alias("pos"), "chart_id")
    return out if most is None else out.where(F.col("pos") < most)


def found_files(ids: DataFrame, files: DataFrame, key: str, extensions: tuple[str, ...], kind: str | None = None) -> DataFrame:
    """ids with the path of their file: of equal stems that in the folder `kind` names first, then by order of extensions, then of paths; null without any."""
    folder, stem = path_parts(F.col("path"))
    rank = F.array_position(F.array(*map(F.lit, extensions)), extension(F.col("path")))
    f = files.select("path", stem.alias("_stem"), folder.alias("_folder"), rank.alias("_rank")).where("_rank > 0")
    j = ids.join(f, F.col(key) == F.col("_stem"), "left")
    typed = (F.col("_folder") == F.col(kind)) if kind else F.lit(True)
    first = F.min_by("path", F.struct((~typed).alias("other"), "_rank", "path"))
    return j.groupBy(*ids.columns).agg(first.alias("path"))


def class_folders(files: DataFrame, negative: str) -> DataFrame:
    """(path, cls, positive) of images in folders that are classes; one folder holds the negatives."""
    folder, _ = path_parts(F.col("path"))
    return files.where(parser_of(F.col("path")) == "image").select("path", folder.alias("cls"), (folder != negative).alias("positive"))


def conversation_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, turns): `conversations` where a row has them, else `messages`, as arrays of (role, content); rows without either go."""
    turns = F.coalesce(F.when(F.size("conversations") > 0, F.col("conversations")), F.when(F.size("messages") > 0, F.col("messages")))
    return rows.select(key, turns.alias("turns")).where("turns IS NOT NULL")


def layered_config(*layers: dict) -> dict:
    """Nested settings of which later layers win, key by key; "${a.b}" stands for another setting's value. Unknown and circular names are errors."""

    def merged(a, b):
        return {**a, **{k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    whole: dict = {}
    for layer in layers:
        whole = merged(whole, layer)

    def looked_up(name, seen):
        if name in seen:
            raise ValueError(f"circular setting {name}")
        at = whole
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                raise KeyError(f"unknown setting {name}")
            at = at[part]
        return resolved(at, (*seen, name))

    def resolved(v, seen=()):
        if isinstance(v, dict):
            return {k: resolved(x, seen) for k, x in v.items()}
        if isinstance(v, list):
            return [resolved(x, seen) for x in v]
        if not isinstance(v, str):
            return v
        if m := re.fullmatch(r"\$\{([^}]+)\}", v):
            return looked_up(m[1], seen)
        return re.sub(r"\$\{([^}]+)\}", lambda m: str(looked_up(m[1], seen)), v)

    return resolved(whole)


def records(spark: SparkSession, glob: str, schema: str, typed: bool = True) -> DataFrame:
    """One row a JSON file, with chart_type and chart_id from its path; broken files and, where folders are chart types, other folders are skipped, of equal stems the last path stays."""
    kind = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    found = contents(listed(spark, glob)).select("path", F.col("content").cast("string").alias("_text"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    one, many = F.from_json("_text", kind, options), F.from_json("_text", T.ArrayType(T.StructType.fromDDL(schema).add("_corrupt", T.StringType())), {"mode": "PERMISSIVE"})
    rows = found.select("path", F.explode(F.when(F.ltrim("_text").startswith("["), many).otherwise(F.array(one))).alias("_row")).where("_row IS NOT NULL")
    folder, stem = path_parts(F.col("path"))
    rows = rows.select("_row.*", "path", folder.alias("chart_type"), stem.alias("chart_id")).where(F.col("_corrupt").isNull())
    if not typed:
        return rows.drop("_corrupt")
    w = Window.partitionBy("chart_id").orderBy(F.desc("path"))
    return rows.where(F.col("chart_type").isin(*CHART_TYPES)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_corrupt")


def inventory(spark: SparkSession, folder: str, most_bytes: int | None = None, depth: int | None = None) -> DataFrame:
    """Files and bytes by directory and extension; contents are never read, files beyond `most_bytes`, or more than `depth` folders below, left out. A folder may be a glob; depth counts below each folder that it names."""
    files = listed(spark, folder)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    if depth is not None:
        below = F.regexp_replace("path", f"^(file:)?/*{_pattern(folder.removeprefix('file:').strip('/'))}/", "")
        files = files.where(F.size(F.split(below, "/")) - 1 <= depth)
    return files.groupBy(path_parts(F.col("path"))[0].alias("folder"), extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def latest_checkpoint(paths: DataFrame, run: str, path: str) -> DataFrame:
    """Of each run the path of the highest checkpoint number."""
    n = F.regexp_extract(path, r"checkpoint-(\d+)$", 1)
    return paths.where(n != "").groupBy(run).agg(F.max_by(path, n.cast("long")).alias(path))


def markdown_images(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each local image reference of a Markdown text, in order; a text without any has one row with a null reference."""
    refs = F.filter(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), lambda r: ~r.rlike(r"^[a-z]+://"))
    return docs.select(key, F.posexplode_outer(F.when(F.size(refs) > 0, refs)).alias("pos", "image"))


def with_cache(requests: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """requests (path) with the cached result, or the computed one where the cache has none; a cached error is an empty result."""
    key = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    hit = cache.select(key("path").alias("_path"), F.when(F.col("error").isNull(), F.col("result")).otherwise("").alias("_cached"))
    return requests.join(hit, key("path") == F.col("_path"), "left").select(*requests.columns, F.coalesce("_cached", compute).alias("result"))
