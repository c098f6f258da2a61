"""Items pulled from a data set's shards, as a batch or as a stream that goes on where it stopped.

A shard is a Parquet file, a row of it an item. `spark.read.format("items")` and `spark.readStream.format("items")` take the
options path (a folder of shards or one), needs (the column without which an item is bad), limit (good items in
all) and groups (row groups a micro-batch, all by default). Bad items are skipped and count towards no limit; an item's id
holds its place among all, bad ones included.

An offset is how many row groups have been read and how many good items they gave, so a restart needs nothing but the
stream's checkpoint. The driver reads the shards' footers alone: row counts and counts of nulls fix what each row group
contributes; executors read the rows. Shards that are added later must sort behind the others by name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType


@dataclass
class Group(InputPartition):
    """A row group: where it is, the place of its first item, and how many good items of it are wanted."""

    path: str
    number: int
    first: int
    good: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def row_groups(path: str, needs: str) -> list[Group]:
    """The row groups of all shards, by name of shard; from footers alone, unless one has no count of nulls."""
    fs, root = _opened(path)
    info = fs.get_file_info(root)
    names = [root] if info.type == pafs.FileType.File else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
    out, first = [], 0
    for name in names:
        with fs.open_input_file(name) as f:
            file = pq.ParquetFile(f)
            at = file.schema_arrow.get_field_index(needs)
            for g in range(file.num_row_groups):
                meta = file.metadata.row_group(g)
                stats = meta.column(at).statistics
                nulls = stats.null_count if stats is not None and stats.has_null_count else file.read_row_group(g, [needs]).column(0).null_count
                out.append(Group(name if root == path else f"{path.rstrip('/')}{name[len(root.rstrip('/')):]}", g, first, meta.num_rows - nulls))
                first += meta.num_rows
    return out


class _Items:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.needs = options["path"], options.get("needs", "text")
        self.limit, self.most = int(options.get("limit", 2**62)), int(options.get("groups", 2**62))
        self.columns = [f.name for f in schema.fields][2:]

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        """Good items of a row group, `partition.good` at most; none where Spark asks for a batch without partitions."""
        if partition is None:
            return
        fs, name = _opened(partition.path)
        left = partition.good
        with fs.open_input_file(name) as f:
            place = partition.first
            for b in pq.ParquetFile(f).iter_batches(1024, row_groups=[partition.number], columns=[*dict.fromkeys([*self.columns, self.needs])]):
                good = pc.is_valid(b.column(self.needs))
                at = pc.add(pa.array(range(b.num_rows), pa.int64()), place)
                ids = pc.binary_join_element_wise("item", pc.utf8_lpad(at.cast(pa.string()), 9, "0"), "_")
                some = pa.RecordBatch.from_arrays([ids, at, *(b.column(c) for c in self.columns)], names=["item_id", "place", *self.columns]).filter(good).slice(0, left)
                place, left = place + b.num_rows, left - some.num_rows
                if some.num_rows:
                    yield some

    def between(self, groups: Sequence[Group], taken: int) -> list[Group]:
        """Of row groups those that are read once `taken` good items are there, cut to the limit."""
        out = []
        for g in groups:
            if taken < self.limit and g.good:
                out.append(Group(g.path, g.number, g.first, min(g.good, self.limit - taken)))
            taken += g.good
        return out


class _Batch(_Items, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.between(row_groups(self.path, self.needs), 0)


class _Stream(_Items, DataSourceStreamReader):
    now: dict | None = None  # the end of the last planned batch; after a restart Spark plans the last one again first

    def initialOffset(self) -> dict:  # noqa: N802
        return {"groups": 0, "taken": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.now = self.now or self.initialOffset()
        for g in row_groups(self.path, self.needs)[self.now["groups"] :][: self.most]:
            if self.now["taken"] >= self.limit:
                break
            self.now = {"groups": self.now["groups"] + 1, "taken": min(self.now["taken"] + g.good, self.limit)}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.now = self.now or end
        return self.between(row_groups(self.path, self.needs)[start["groups"] : end["groups"]], start["taken"])

    def commit(self, end: dict) -> None:
        self.now = self.now or end


class ItemSource(DataSource):
    """Rows (item_id, place, columns of the shards)."""

    @classmethod
    def name(cls) -> str:
        return "items"

    def schema(self) -> StructType:
        fs, root = _opened(self.options["path"])
        info = fs.get_file_info(root)
        name = root if info.type == pafs.FileType.File else min(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
        with fs.open_input_file(name) as f:
            found = from_arrow_schema(pq.read_schema(f))
        wanted = [c for c in self.options.get("columns", ",".join(found.names)).split(",")]
        return StructType([StructField("item_id", StringType()), StructField("place", LongType()), *(found[c] for c in wanted)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ItemSource)
