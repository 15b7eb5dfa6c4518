"""Session settings, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.functions.vectors import plain_encoding

DEFAULTS = {
    # Integer overflow must fail, never wrap.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A partitioned write keeps several files open instead of sorting whole rows first.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
}


# Data that one shuffle partition should hold.
SHUFFLE_BYTES = 256 << 20


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``, overridden by ``conf`` (``**{"spark.x": "v"}``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Set the shuffle partitions for an input of this size and return their number.

    A partition gets about ``SHUFFLE_BYTES``, so that it sorts in memory, and each core at least
    one. Spark joins those that turn out small, but never splits ones that are too few.
    """
    wanted = max(-(-input_bytes // SHUFFLE_BYTES), spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` when the cluster names one.

    Only a local session may fall back to a temporary folder, because there every task sees it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vecmill-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below ``shared_dir`` that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with these options of the Parquet writer, and read it back.

    Fixes values that would differ when recomputed (range bounds, row positions), survives the
    loss of executors, and leaves a columnar table that later steps can prune.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**plain_encoding(df), **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """A few rows, written into the plan as literals; one partition, so one file when written."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
