"""Seeded order, samples and mini-batches that do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of the key that name a bucket: 65,536 buckets at most, evenly filled.
BUCKET_DIGITS = 4
# Largest sample that is taken by a top-n in each task; a larger one is cut by rank.
TOP_N_ROWS = 10_000


def shuffle_key(id_col: str, seed: int | str) -> Column:
    """Sort key of the seeded order. Depends on the id and the seed only, unlike ``rand``."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.md5(F.concat(name, F.lit(f":{seed}")))


def seeded_rank(df: DataFrame, id_col: str, seed: int | str, output: str = "rank") -> DataFrame:
    """Append the 1-based position of each row in the seeded order. ``id_col`` must be unique.

    No global window: rows are ranked within a bucket of the key and moved by the number of rows
    in earlier buckets. The offsets (one row per bucket, so at most 65,536) come from a scan of
    the id alone. Keys are digests, so buckets stay even whatever the ids are.
    """
    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    keyed = df.withColumn("_key", shuffle_key(id_col, seed)).withColumn("_bucket", bucket)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        keyed.withColumn("_within", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(output, F.col("_offset") + F.col("_within"))
        .drop("_key", "_bucket", "_within", "_offset")
    )


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of the seeded order (all rows if there are fewer)."""
    if n < 0:
        raise ValueError(f"n must not be negative, got {n}")
    if n <= TOP_N_ROWS:
        return (
            df.withColumn("_key", shuffle_key(id_col, seed))
            .orderBy("_key", id_col)
            .limit(n)
            .drop("_key")
        )
    return seeded_rank(df, id_col, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def mini_batches(
    df: DataFrame,
    id_col: str,
    batch_size: int,
    seed: int = 42,
    shuffle: bool = True,
    order_col: str | None = None,
    epoch: int | None = None,
) -> DataFrame:
    """Append ``batch`` and ``pos``: rows in seeded order, ``batch_size`` to a batch, both from 0.

    The order is that of the seed, or with ``epoch`` that of the seed and the epoch.
    With ``shuffle=False`` the rows must already carry their 1-based position in ``order_col``.
    """
    if batch_size < 1:
        raise ValueError(f"batch_size must be at least 1, got {batch_size}")
    if shuffle:
        key = seed if epoch is None else f"{seed}:{epoch}"
        ranked, order = seeded_rank(df, id_col, key, "_rank"), F.col("_rank")
    elif order_col:
        ranked, order = df, F.col(order_col)
    else:
        raise ValueError("shuffle=False needs order_col")
    return ranked.select(
        *df.columns,
        F.call_function("div", order - 1, F.lit(batch_size)).alias("batch"),
        ((order - 1) % batch_size).cast("int").alias("pos"),
    )


def collect_batches(batched: DataFrame, columns: list[str]) -> DataFrame:
    """One row per batch, each of ``columns`` as an array in batch order.

    A group is never larger than the batch size it was made with.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    grouped = batched.groupBy("batch").agg(rows.alias("_rows"))
    return grouped.select("batch", *[F.col("_rows")[c].alias(c) for c in columns])
