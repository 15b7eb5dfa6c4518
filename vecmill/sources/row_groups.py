"""Parquet files as a stream of row groups.

Offsets are places between row groups, ``(time, file, group)``, so one large file can be several
chunks, and a chunk has a bounded number of rows. Footers are read only as far as a chunk reaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql import types as T

FORMAT = "parquet_row_groups"
START = {"time": 0, "file": "", "group": 0}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str]]:
    """Data files by time of arrival, then name; hidden ones and markers are left out."""
    system, root = _open(path.replace("file:///", "/"))
    info = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    found = [f for f in info if f.type == fs.FileType.File and f.path.endswith(".parquet")]
    hidden = lambda f: any(part[:1] in "._" for part in f.path[len(root) :].strip("/").split("/"))
    return sorted((f.mtime_ns or 0, f.path) for f in found if not hidden(f))


def _footer(path: str, file: str) -> pq.FileMetaData:
    system, _ = _open(path.replace("file:///", "/"))
    with system.open_input_file(file) as source:
        return pq.read_metadata(source)


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int


class RowGroupStream(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, path: str, rows: int, resume: dict | None):
        self.schema, self.path, self.rows = schema, path, rows
        self.at = resume or dict(START)

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        """The end of the next chunk: row groups of at most ``rows`` rows, or one larger row group."""
        taken = 0
        for time, file in _files(self.path):
            if (time, file) < (self.at["time"], self.at["file"]):
                continue
            footer = _footer(self.path, file)
            first = self.at["group"] if (time, file) == (self.at["time"], self.at["file"]) else 0
            for group in range(first, footer.num_row_groups):
                rows = footer.row_group(group).num_rows
                if taken and taken + rows > self.rows:
                    return self.at
                taken += rows
                self.at = {"time": time, "file": file, "group": group + 1}
            if taken >= self.rows:
                break
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The row groups between two offsets, each a task."""
        low, high = ((o["time"], o["file"], o["group"]) for o in (start, end))
        found: list[InputPartition] = []
        for time, file in _files(self.path):
            if low[:2] <= (time, file) <= high[:2]:
                groups = _footer(self.path, file).num_row_groups
                found += [RowGroup(file, g) for g in range(groups) if low <= (time, file, g) < high]
        return found

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path.replace("file:///", "/"))
        wanted = to_arrow_schema(self.schema)
        with system.open_input_file(partition.file) as source:
            table = pq.ParquetFile(source).read_row_group(partition.group, columns=wanted.names)
            yield from table.select(wanted.names).cast(wanted).to_batches()


class RowGroupSource(DataSource):
    """Options: ``path`` (any URI that Arrow's file systems open), ``rows`` of a chunk, and ``resume``,
    the offset to go on from as JSON."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        path = self.options["path"]
        files = _files(path)
        if not files:
            raise ValueError(f"no Parquet file in {path}")
        return from_arrow_schema(_footer(path, files[0][1]).schema.to_arrow_schema())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        resume = self.options.get("resume")
        return RowGroupStream(schema, self.options["path"], int(self.options["rows"]), json.loads(resume) if resume else None)


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The offset up to which the chunks of a stream with this checkpoint are planned, as JSON."""
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    if not log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
        return None
    rows = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(F.col("_metadata.file_name").alias("number"), "value").collect()
    return max(rows, key=lambda r: int(r.number)).value.splitlines()[2] if rows else None
