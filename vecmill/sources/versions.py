"""Versioned datasets: each write makes a new version, old ones stay readable.

With ``table_format="delta"`` this is Delta Lake's own reader and writer, for clusters that have
its jar. The default keeps whole snapshots as plain Parquet: ``<path>/data/version=N`` and one
row per version in ``<path>/history``. A version exists once its history row does, so a job that
dies while writing leaves nothing visible, and its number is used again. One writer at a time.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.functions.vectors import plain_encoding
from vecmill.operators.batches import observe_rows
from vecmill.session import literal_rows
from vecmill.sources.files import exists

HISTORY = "version long, ts timestamp, operation string, rows long"


def _check(table_format: str) -> bool:
    if table_format not in ("snapshot", "delta"):
        raise ValueError(f"table_format must be 'snapshot' or 'delta', not {table_format!r}")
    return table_format == "delta"


def history(spark: SparkSession, path: str, table_format: str = "snapshot") -> DataFrame:
    """One row per version."""
    if _check(table_format):
        return spark.sql(f"DESCRIBE HISTORY delta.`{path}`")
    if not exists(spark, f"{path}/history"):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(f"{path}/history")


def latest_version(spark: SparkSession, path: str, table_format: str = "snapshot") -> int | None:
    """Number of the newest version, ``None`` before the first write."""
    return history(spark, path, table_format).agg(F.max("version")).first()[0]


def write_version(
    df: DataFrame,
    path: str,
    table_format: str = "snapshot",
    max_rows_per_file: int | None = None,
) -> int:
    """Write ``df`` as the next version and return its number. ``df`` may read older versions."""
    spark = df.sparkSession
    options = plain_encoding(df)
    if max_rows_per_file is not None:
        options["maxRecordsPerFile"] = str(max_rows_per_file)
    if _check(table_format):
        writer = df.write.format("delta").mode("overwrite").options(**options)
        writer.option("overwriteSchema", "true").save(path)
        return latest_version(spark, path, table_format)
    last = latest_version(spark, path)
    version = 0 if last is None else last + 1
    counted, rows = observe_rows(df, f"version-{version}")
    # Overwrite: a failed attempt may have left files under this number.
    counted.write.mode("overwrite").options(**options).parquet(_data(path, version))
    entry = (version, datetime.now(timezone.utc), "overwrite", rows.get["rows"])
    literal_rows(spark, [entry], HISTORY).write.mode("append").parquet(f"{path}/history")
    return version


def read_version(
    spark: SparkSession, path: str, version: int | None = None, table_format: str = "snapshot"
) -> DataFrame:
    """A given version, or the latest."""
    if _check(table_format):
        reader = spark.read.format("delta")
        return (reader if version is None else reader.option("versionAsOf", version)).load(path)
    if version is None:
        version = latest_version(spark, path)
    elif history(spark, path).filter(F.col("version") == version).isEmpty():
        raise ValueError(f"no version {version} at {path}")
    if version is None:
        raise ValueError(f"no version at {path}")
    return spark.read.parquet(_data(path, version))


def export_version(
    spark: SparkSession, path: str, dest: str, version: int | None = None, mode: str = "error"
) -> None:
    """Rewrite a version as flat Parquet under ``dest``, in parallel."""
    table = read_version(spark, path, version)
    table.write.mode(mode).options(**plain_encoding(table)).parquet(dest)


def _data(path: str, version: int) -> str:
    return f"{path}/data/version={version}"
