"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.operators.batches import POSITION_BITS
from vecmill.session import cut_lineage


def global_rank(df: DataFrame, order: list[Column], output: str = "rank") -> DataFrame:
    """Append the 1-based rank by ``order``, which must leave no ties.

    Rows are range-partitioned and sorted by task, and that layout is written to the shared
    folder: range bounds are sampled, so a recomputed layout could differ. Each partition is then
    moved by the row count of those before it (one row per partition, broadcast).
    """
    slot = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", slot)
        .withColumn("_part", F.shiftright("_slot", POSITION_BITS))
        .withColumn("_pos", F.col("_slot").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
        .drop("_slot")
    )
    fixed = cut_lineage(placed, "ranked")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(output, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def running_total(df: DataFrame, key: str, order: list[Column], value: Column, output: str = "before") -> DataFrame:
    """Append the sum of ``value`` over the rows of the same ``key`` that come before by ``order``.

    No window over a whole key: rows are range-partitioned by key and order, so a key that holds much
    of the data lies in several tasks, and that layout is written. Sums are formed within a task;
    a key that begins in an earlier one is moved by what is there. Only the first key of a
    partition can, so there is at most one such row for each partition, which is broadcast.
    """
    placed = df.repartitionByRange(F.col(key), *order).withColumn("_value", value.cast("long")).withColumn("_part", F.spark_partition_id())
    fixed = cut_lineage(placed, "running")
    within = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = fixed.groupBy("_part", key).agg(F.sum("_value").alias("_sum"))
    continued = parts.withColumn("_offset", F.sum("_sum").over(earlier)).filter(F.col("_offset").isNotNull())
    offsets = continued.select(F.col("_part").alias("_at"), F.col(key).alias("_of"), "_offset")
    same = (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_of"))
    return (
        fixed.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(F.broadcast(offsets), same, "left")
        .withColumn(output, F.col("_within") + F.coalesce("_offset", F.lit(0)))
        .drop("_part", "_value", "_within", "_at", "_of", "_offset")
    )
