"""Counts, accuracy, step numbers and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count(df: DataFrame) -> DataFrame:
    """One row with ``rows``; on Parquet this reads footers, not columns."""
    return df.agg(F.count("*").alias("rows"))


def accuracy(df: DataFrame, prediction: str, reference: str, by: str | None = None) -> DataFrame:
    """``(rows, correct, accuracy)`` in total, or per value of ``by``. Pairs with a null count as
    rows but not as correct."""
    correct = F.coalesce((F.col(prediction) == F.col(reference)).cast("long"), F.lit(0))
    grouped = df.groupBy(by) if by else df.groupBy()
    totals = grouped.agg(F.count("*").alias("rows"), F.sum(correct).alias("correct"))
    return totals.withColumn(
        "accuracy", F.when(F.col("rows") > 0, F.col("correct").cast("double") / F.col("rows"))
    )


def steps_per_epoch(df: DataFrame, batch_size: int, epochs: int) -> DataFrame:
    """``(rows, steps_per_epoch, total_steps)`` for batches of ``batch_size``."""
    steps = F.ceil(F.col("rows") / batch_size).cast("long")
    return (
        row_count(df)
        .withColumn("steps_per_epoch", steps)
        .withColumn("total_steps", F.col("steps_per_epoch") * epochs)
    )


def number_steps(
    batched: DataFrame, epochs: int, per_epoch: int | Column, step: str = "batch"
) -> DataFrame:
    """Repeat each batch row once per epoch, with ``epoch`` and the step number over all epochs.

    ``batched`` holds one row per batch, numbered from 0 in ``step``; ``per_epoch`` is their
    number, from ``steps_per_epoch``.
    """
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    return batched.withColumn("epoch", epoch).withColumn(
        "global_step", F.col(step) + F.col("epoch") * per_epoch
    )


def meets_minimum(df: DataFrame, minimum: int) -> DataFrame:
    """One row: ``rows`` and whether they reach ``minimum``."""
    return row_count(df).withColumn("meets_minimum", F.col("rows") >= minimum)


def require_minimum(df: DataFrame, minimum: int) -> DataFrame:
    """``df`` itself, or an error when it has fewer rows; reads no more than it must to tell."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"{found} rows, at least {minimum} needed")
    return df


def dataset_profile(df: DataFrame, distinct: str | None = "approx") -> DataFrame:
    """One row per column: rows, nulls, distinct values, smallest and largest value, mean.

    Array columns report their sizes in place of values. All but exact distinct counts come from
    one pass. ``distinct="exact"`` counts each column in its own scan of that column (strings by
    digest), which shuffles less than one aggregate that expands every row once per column.
    """
    if distinct not in ("approx", "exact", None):
        raise ValueError(f"distinct must be 'approx', 'exact' or None, not {distinct!r}")
    aggregates: list[Column] = [F.count("*").alias("rows")]
    for i, field in enumerate(df.schema):
        column = F.col(f"`{field.name}`")
        array = isinstance(field.dataType, T.ArrayType)
        value = F.when(column.isNotNull(), F.size(column)) if array else column
        numeric = array or isinstance(field.dataType, T.NumericType)
        aggregates += [
            F.count(column).alias(f"c{i}"),
            F.min(value).cast("string").alias(f"lo{i}"),
            F.max(value).cast("string").alias(f"hi{i}"),
            (F.avg(value).cast("double") if numeric else F.lit(None).cast("double")).alias(f"m{i}"),
        ]
        if distinct == "approx":
            aggregates.append(F.approx_count_distinct(column).alias(f"d{i}"))
    once = df.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col("rows"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
            (F.col(f"d{i}") if distinct == "approx" else F.lit(None).cast("long")).alias("n_distinct"),
            F.col(f"lo{i}").alias("lowest"),
            F.col(f"hi{i}").alias("highest"),
            F.col(f"m{i}").alias("mean"),
        )
        for i, field in enumerate(df.schema)
    ]
    profile = once.select(F.inline(F.array(*entries)))
    if distinct != "exact":
        return profile
    counts = [
        df.select(_digest(field).alias("v"))
        .filter(F.col("v").isNotNull())
        .distinct()
        .agg(F.count("*").alias("n_distinct"))
        .select(F.lit(field.name).alias("column"), "n_distinct")
        for field in df.schema
    ]
    # One row per column on either side.
    return profile.drop("n_distinct").join(F.broadcast(reduce(DataFrame.unionByName, counts)), "column")


def _digest(field: T.StructField) -> Column:
    """What to count a column by: long values go through the shuffle as 128-bit digests."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.md5(column.cast("binary"))
    if isinstance(field.dataType, (T.ArrayType, T.StructType)):
        return F.when(column.isNotNull(), F.md5(F.to_json(column)))
    return column
