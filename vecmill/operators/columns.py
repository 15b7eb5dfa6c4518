"""Column bookkeeping that fails where Spark would silently do nothing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _require(df: DataFrame, columns: tuple[str, ...]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} in {df.columns}")


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    _require(df, columns)
    return df.drop(*columns)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _require(df, (old,))
    if new != old and new in df.columns:
        raise ValueError(f"column {new!r} exists")
    return df.withColumnRenamed(old, new)


def append_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a column and keep all others; an existing name is an error."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.withColumn(name, value)


def append_equals(df: DataFrame, name: str, column: str, value: Any) -> DataFrame:
    """Append a boolean that is true where ``column`` equals ``value``; null gives false."""
    _require(df, (column,))
    return append_column(
        df, name, F.when(F.col(column) == F.lit(value), True).otherwise(False)
    )


def replicate(df: DataFrame, times: int, output: str = "rep") -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``output``; map-only."""
    if times < 1:
        raise ValueError(f"times must be at least 1, not {times}")
    return append_column(df, output, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the declared column order, or an error naming what differs from ``schema``.

    Nullability is not compared: Spark marks every column of a file as nullable.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in schema}
    if have != want:
        odd = sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
        detail = ", ".join(f"{n}: {have.get(n)} for {want.get(n)}" for n in odd)
        raise TypeError(f"columns differ from the declared schema: {detail}")
    return df.select(*schema.names)
