"""The batch jobs: one transformation, five ways to distribute it, and two smoke jobs.

``python -m vecmill.plans.jobs <job> --help`` lists the options of each.
"""

from __future__ import annotations

import argparse
import socket
import time
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vecmill.functions.vectors import append_scaled
from vecmill.operators.batches import (
    batch_rows,
    fan_out,
    map_batches,
    task_range,
    with_elements,
)
from vecmill.operators.columns import append_equals
from vecmill.operators.shards import own_files, read_shard
from vecmill.session import build_session
from vecmill.sinks.files import with_output_name, write_dataset, write_manifest, write_per_input
from vecmill.sources.files import read_parquet, source_root
from vecmill.sources.versions import latest_version, read_version, write_version
from vecmill.streaming.chunks import process_chunks

# Rows per batch unless told otherwise, tasks and pause of the fan-out smoke job,
# rows of the Spark smoke job.
BATCH_ROWS = 27_528
SMOKE_TASKS = 1000
SMOKE_PAUSE = 0.01
SMOKE_ROWS = [(2022, "tiger"), (2023, "rabbit"), (2024, "dragon")]


def double_batch(column: str = "vector") -> Callable[[pa.Table], pa.Table]:
    """The transformation as a user function on Arrow batches, over flat element buffers."""

    def double(batch: pa.Table) -> pa.Table:
        vectors = batch[column].combine_chunks()
        elements = vectors.flatten()
        products = pc.multiply_checked(elements, pa.scalar(2, elements.type))
        doubled = with_elements(vectors, products).cast(vectors.type)
        return batch.append_column(f"{column}_x2", doubled)

    return double


def process_shards(
    spark: SparkSession, source: str, target: str, instances: int, shard: int | None = None
) -> str:
    """Per-file outputs. One job does all files, since Spark spreads them itself; with ``shard``
    it does only the files of that shard, for clusters that split the work among jobs.

    Outputs are named by the path of their input below ``source``. What was read and written is
    listed below ``manifest_path``, one part for each shard."""
    whole, root = read_parquet(spark, source), source_root(spark, source)
    scan = whole if shard is None else read_shard(spark, source, shard, instances)
    paths = [source] if shard is None else own_files(whole, shard, instances)
    out = f"{target}/instance_count={instances}"
    write_per_input(append_scaled(with_output_name(scan, root)), out)
    if paths:
        part = "all" if shard is None else str(shard)
        write_manifest(spark, paths, root, f"{manifest_path(target, instances)}/part={part}")
    return out


def manifest_path(target: str, instances: int) -> str:
    """Where ``process_shards`` lists its inputs; readers of ``target`` do not see it."""
    return f"{target}/_manifest/instance_count={instances}"


def process_table(
    spark: SparkSession,
    source: str,
    target: str,
    batch_size: int,
    checkpoint: str | None = None,
    max_files: int | None = None,
    commit_rows: int | None = None,
) -> str:
    """The table form: via float32, at most ``batch_size`` rows to a file.

    Without ``checkpoint`` the result is one new version of the target, so readers see all of it
    or nothing. With it, new files of ``source`` are worked through in chunks of ``max_files``, or, with
    ``commit_rows``, in commits of at most so many rows, rounded to row groups.
    """
    size = batch_rows(batch_size)
    out = f"{target}/batch_size={size}"

    def transform(df: DataFrame) -> DataFrame:
        return append_scaled(df, via="float32")

    if checkpoint is not None:
        process_chunks(spark, source, out, checkpoint, transform, max_files, max_rows=commit_rows)
        return out
    versioned = latest_version(spark, source) is not None
    table = read_version(spark, source) if versioned else read_parquet(spark, source)
    write_version(transform(table), out, max_rows_per_file=size)
    return out


def process_batches(
    spark: SparkSession, source: str, target: str, batch_size: int = BATCH_ROWS, mode: str = "error"
) -> str:
    """A user function on Arrow batches, from any URI to any URI."""
    size = batch_rows(batch_size)
    out = f"{target}/batch_size={size}"
    write_dataset(map_batches(read_parquet(spark, source), double_batch(), size), out, mode)
    return out


def process_instances(
    spark: SparkSession,
    source: str,
    target: str,
    instances: int,
    batch_size: int = BATCH_ROWS,
    mode: str = "error",
) -> str:
    """As ``process_batches``, with the output kept per number of instances."""
    out = f"{target}/instance_count={instances}"
    write_dataset(map_batches(read_parquet(spark, source), double_batch(), batch_size), out, mode)
    return out


def smoke_hosts(spark: SparkSession, n: int = SMOKE_TASKS) -> DataFrame:
    """Distinct host names that ``n`` small tasks ran on."""

    def host(_task: int) -> str:
        time.sleep(SMOKE_PAUSE)
        return socket.gethostname()

    return fan_out(task_range(spark, n), host).distinct()


def smoke_rows(spark: SparkSession) -> DataFrame:
    """A few inline rows with a conditional column."""
    rows = spark.createDataFrame(SMOKE_ROWS, schema=["year", "animal"])
    return append_equals(rows, "from_fantasy_fiction", "animal", "dragon")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vecmill")
    jobs = parser.add_subparsers(dest="job", required=True)

    def add(name: str, files: bool = True) -> argparse.ArgumentParser:
        job = jobs.add_parser(name)
        job.add_argument("--local", action="store_true", help="run on this machine's cores")
        if files:
            job.add_argument("--source", required=True)
            job.add_argument("--target", required=True)
        return job

    shards = add("shards")
    shards.add_argument("--instances", type=int, required=True)
    shards.add_argument("--shard", type=int)
    table = add("table")
    table.add_argument("--batch-size", type=int, required=True)
    table.add_argument("--checkpoint", help="work through new files of the source in chunks")
    table.add_argument("--max-files", type=int, help="files to a chunk")
    batches = add("batches")
    batches.add_argument("--batch-size", type=int, default=BATCH_ROWS)
    batches.add_argument("--mode", default="error")
    instances = add("instances")
    instances.add_argument("--instances", type=int, required=True)
    instances.add_argument("--batch-size", type=int, default=BATCH_ROWS)
    instances.add_argument("--mode", default="error")
    add("smoke-hosts", files=False)
    add("smoke-rows", files=False)

    args = parser.parse_args(argv)
    spark = build_session(f"vecmill-{args.job}", master="local[*]" if args.local else None)
    if args.job == "shards":
        print(process_shards(spark, args.source, args.target, args.instances, args.shard))
    elif args.job == "table":
        print(
            process_table(
                spark, args.source, args.target, args.batch_size, args.checkpoint, args.max_files
            )
        )
    elif args.job == "batches":
        print(process_batches(spark, args.source, args.target, args.batch_size, args.mode))
    elif args.job == "instances":
        print(
            process_instances(
                spark, args.source, args.target, args.instances, args.batch_size, args.mode
            )
        )
    elif args.job == "smoke-hosts":
        smoke_hosts(spark).show(truncate=False)
    else:
        rows = smoke_rows(spark)
        rows.show(5)
        rows.printSchema()


if __name__ == "__main__":
    main()
