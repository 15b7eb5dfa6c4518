"""Parquet sources and what is known about their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_PATH = "_metadata.file_path"

# Largest scan, in bytes of its files, that ``spread`` hands out anew.
SPREAD_BYTES = 1 << 30


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file, a directory or several of them, by any URI the cluster has a file system for."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a dataset written with a ``split`` partition; other splits are not opened."""
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hand a small scan out to all cores by ``key``, a unique id, before CPU-heavy work.

    A row group is read by one task, so a small file keeps most cores idle. Beyond
    ``SPREAD_BYTES``, or with a file for each core, ``df`` comes back as it is: there, rows are
    not moved.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    size = sum(_status(spark, file).getLen() for file in files)
    return df if size > SPREAD_BYTES else df.repartition(cores, key)


def _status(spark: SparkSession, uri: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or directory at ``path``, by the cluster's own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def source_root(spark: SparkSession, source: str) -> str:
    """The folder of ``source``, a folder or one file, as a URI: what its files are named relative
    to. A pattern has no such folder, so its files keep their whole path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return ""
    folder = place if system.getFileStatus(place).isDirectory() else place.getParent()
    # Rows name local files with one slash.
    return system.makeQualified(folder).toUri().toString().replace("file:///", "file:/", 1)


def relative_path(root: str, uri: str = FILE_PATH) -> Column:
    """The file of a scanned row relative to ``root``, so that equal names in different folders
    stay apart."""
    path = without_prefix(uri, root.rstrip("/") + "/")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def list_files(df: DataFrame) -> list[str]:
    """The files a scan covers, sorted; known from planning, no data is read."""
    return sorted(df.inputFiles())


def file_rows(spark: SparkSession, paths: str | list[str], root: str = "") -> DataFrame:
    """``(file_name, rows)`` of every file at ``paths``, which may be different tables, with names
    relative to ``root``: one job over the row counts in the files, no column is read. Files come
    from the listing, so one without rows counts 0."""
    paths = [paths] if isinstance(paths, str) else paths
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    any_table = spark.read.schema("unread string").option("recursiveFileLookup", "true")
    counted = any_table.parquet(*paths).groupBy(F.col(FILE_PATH).alias("path")).agg(F.count("*").alias("n"))
    files = listed.select(F.col(FILE_PATH).alias("path"))
    return files.join(counted, "path", "left").select(
        relative_path(root, "path").alias("file_name"), F.coalesce("n", F.lit(0)).alias("rows")
    )


def dataset_bytes(spark: SparkSession, path: str) -> int:
    """Size of the Parquet files below ``path``, from the file listing alone."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    return listing.agg(F.sum("length")).first()[0] or 0


def base_name(path: str | Column) -> Column:
    """Last part of a path or URI."""
    path = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(path, "/"), -1)


def without_prefix(path: str | Column, prefix: str) -> Column:
    """A URI relative to ``prefix``; unchanged when it does not start with it."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    ).otherwise(path)


def processed_name(file_name: str | Column) -> Column:
    """Name of the output that belongs to an input file; its folder stays."""
    file_name = F.col(file_name) if isinstance(file_name, str) else file_name
    base = base_name(file_name)
    folder = F.substring(file_name, F.lit(1), F.length(file_name) - F.length(base))
    return F.concat(folder, F.lit("processed_"), base)
