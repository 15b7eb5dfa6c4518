"""Parquet and JSON-lines sinks. None of them shuffles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.functions.messages import BATCH_MINIMUM
from vecmill.functions.vectors import plain_encoding
from vecmill.operators.columns import append_column, conform
from vecmill.operators.metrics import require_minimum
from vecmill.sources.files import dataset_bytes, file_rows, processed_name, relative_path

FILE_BYTES = 1 << 30


def write_dataset(
    df: DataFrame, path: str, mode: str, schema: T.StructType | None = None
) -> None:
    """Write Parquet. ``mode`` has no default, so that nothing is replaced by accident; with
    ``schema`` the columns must match it."""
    if schema is not None:
        df = conform(df, schema)
    df.write.mode(mode).options(**plain_encoding(df)).parquet(path)


def with_output_name(scan: DataFrame, root: str, output: str = "output_file") -> DataFrame:
    """Tag the rows of a plain file scan with the output name of their input file below ``root``."""
    return append_column(scan, output, processed_name(relative_path(root)))


def write_manifest(spark: SparkSession, paths: str | list[str], root: str, dest: str) -> None:
    """``(input, output, rows)`` of every input file, also of those without rows, which have no
    output of their own."""
    files = file_rows(spark, paths, root)
    named = files.select(F.col("file_name").alias("input"), processed_name("file_name").alias("output"), "rows")
    named.coalesce(1).write.mode("overwrite").parquet(dest)


def write_per_input(df: DataFrame, path: str, output: str = "output_file") -> None:
    """One output directory ``output_file=<folder>/processed_<name>`` per input file, for rows tagged by
    ``with_output_name``. Map-only: a task writes the outputs of the files it reads. Outputs of
    other inputs stay, so shards can be written one by one and again."""
    (
        df.write.mode("overwrite")
        .options(**plain_encoding(df), partitionOverwriteMode="dynamic")
        .partitionBy(output)
        .parquet(path)
    )


def write_parameterised(df: DataFrame, path: str, **parameter: object) -> None:
    """Write below ``<path>/<name>=<value>/``, replacing the earlier output of the same
    parameters and leaving all others. Reading ``path`` gives the parameters back as columns."""
    if not parameter:
        raise ValueError("at least one parameter is needed")
    for name, value in parameter.items():
        df = append_column(df, name, F.lit(value))
    (
        df.write.mode("overwrite")
        .options(**plain_encoding(df), partitionOverwriteMode="dynamic")
        .partitionBy(*parameter)
        .parquet(path)
    )


def compact(
    spark: SparkSession,
    path: str,
    dest: str,
    target_bytes: int = FILE_BYTES,
    mode: str = "error",
    max_rows_per_file: int | None = None,
) -> None:
    """Rewrite Parquet files to about ``target_bytes`` each, small ones joined, large ones split
    at row groups.

    Not a ``repartition``: the scan itself packs files into tasks of the target size, and each
    task writes one file, so no row is shuffled. The packing is set in a session of its own.
    """
    if target_bytes < 1:
        raise ValueError(f"target_bytes must be positive, got {target_bytes}")
    packing = spark.newSession()
    packing.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    packing.conf.set("spark.sql.files.openCostInBytes", "0")
    packing.conf.set("spark.sql.files.minPartitionNum", "1")
    packed = packing.read.parquet(path)
    writer = packed.write.mode(mode).options(**plain_encoding(packed))
    if max_rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(dest)


def compacted_files(spark: SparkSession, path: str, target_bytes: int = FILE_BYTES) -> int:
    """How many files ``compact`` aims at."""
    return max(1, math.ceil(dataset_bytes(spark, path) / target_bytes))


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row, or the rows as they are when ``df`` is a single string column."""
    if [f.dataType for f in df.schema] != [T.StringType()]:
        df = df.select(F.to_json(F.struct("*")).alias("value"))
    df.write.mode(mode).text(path)


def write_requests(requests: DataFrame, path: str, minimum: int = BATCH_MINIMUM, mode: str = "error") -> None:
    """Requests as JSON lines, one to a row, or an error before anything is written when there are fewer
    than a batch must hold. Pass written rows: they are read twice."""
    write_json_lines(require_minimum(requests, minimum), path, mode)
