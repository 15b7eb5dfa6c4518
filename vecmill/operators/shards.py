"""Disjoint file shards."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.sources.files import FILE_PATH

# Largest file list, in bytes of paths, that is broadcast to tag rows.
BROADCAST_BYTES = 32 << 20


def shard_files(df: DataFrame, shards: int) -> list[tuple[str, int]]:
    """``(path, shard)`` for the input files of ``df``: the sorted list is dealt out in turn, so
    shards differ by one file at most. The list is what the session already holds to plan the
    scan; no data is read."""
    if shards < 1:
        raise ValueError(f"shards must be at least 1, got {shards}")
    # Rows name local files with one slash, the list with three.
    files = sorted(file.replace("file:///", "file:/", 1) for file in df.inputFiles())
    return [(file, i % shards) for i, file in enumerate(files)]


def file_shards(df: DataFrame, shards: int) -> DataFrame:
    """The assignment as a DataFrame ``(file_path, shard)``."""
    return df.sparkSession.createDataFrame(
        shard_files(df, shards), "file_path string, shard int"
    )


def append_shard(df: DataFrame, shards: int, output: str = "shard") -> DataFrame:
    """Tag each row with the shard of the file it comes from. ``df`` must be a plain file scan."""
    files = shard_files(df, shards)
    assigned = df.sparkSession.createDataFrame(files, f"_file string, {output} int")
    if sum(len(path) for path, _ in files) <= BROADCAST_BYTES:
        assigned = F.broadcast(assigned)
    return df.withColumn("_file", F.col(FILE_PATH)).join(assigned, "_file").drop("_file")


def own_files(whole: DataFrame, shard: int, shards: int) -> list[str]:
    """The files of one shard of a scan, as paths that can be read."""
    if not 0 <= shard < shards:
        raise ValueError(f"shard must be within 0..{shards - 1}, got {shard}")
    # Listed as URIs, read as paths.
    return [unquote(file) for file, number in shard_files(whole, shards) if number == shard]


def read_shard(spark: SparkSession, path: str, shard: int, shards: int) -> DataFrame:
    """Only the files of one shard: the others are never opened. May be empty."""
    whole = spark.read.parquet(path)
    own = own_files(whole, shard, shards)
    if not own:
        return whole.limit(0)
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*own)
