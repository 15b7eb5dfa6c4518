"""Work through a growing dataset in chunks, one commit per chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.functions.vectors import plain_encoding
from vecmill.sources import row_groups

# By default the file source forgets files that are a week older than the newest one.
ANY_AGE = "36500d"


def process_chunks(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    max_files: int | None = None,
    max_bytes: str | None = None,
    max_rows: int | None = None,
) -> None:
    """Run ``transform`` over the files of ``source`` that ``checkpoint`` has not seen, at most
    ``max_files`` (or ``max_bytes``, such as ``"10g"``) to a chunk, and return when none is left.
    By default a chunk has a file for each core of the cluster, so that none is idle. With
    ``max_rows`` a chunk is row groups of at most so many rows together (or one larger row group),
    whatever files they are in; files are taken in the order in which they arrived, and must not
    change afterwards.

    Chunk 0 replaces ``target``, later ones add to it. Each chunk is the partition
    ``batch_id=<n>`` and is written by overwriting just that, so a chunk that is run again after
    a failure leaves the same rows. Within a chunk Spark works in parallel as usual.
    """
    def commit(chunk: DataFrame, number: int) -> None:
        write_chunk(transform(chunk), target, number)

    if max_rows is not None:
        spark.dataSource.register(row_groups.RowGroupSource)
        stream = spark.readStream.format(row_groups.FORMAT).options(path=source, rows=max_rows)
        if resume := row_groups.last_offset(spark, checkpoint):
            stream = stream.option("resume", resume)
        query = stream.load().writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFileAge", ANY_AGE)
    if max_bytes is not None:
        stream = stream.option("maxBytesPerTrigger", max_bytes)
    else:
        files = max_files or spark.sparkContext.defaultParallelism
        stream = stream.option("maxFilesPerTrigger", files)

    query = (
        stream.parquet(source)
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_chunk(chunk: DataFrame, target: str, number: int) -> None:
    """Commit chunk ``number``: the first clears ``target``, any other replaces only itself."""
    replaced = "static" if number == 0 else "dynamic"
    (
        chunk.withColumn("batch_id", F.lit(number))
        .write.mode("overwrite")
        .options(**plain_encoding(chunk), partitionOverwriteMode=replaced)
        .partitionBy("batch_id")
        .parquet(target)
    )
