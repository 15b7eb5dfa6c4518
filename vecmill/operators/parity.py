"""Do two DataFrames hold the same rows?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Buckets of rows that are compared by digest before any row is moved.
BUCKETS = 4096
LOW = (1 << 32) - 1


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``surplus`` copies on the left (negative: right).

    One shuffle of both sides for the two-way comparison; copies are counted in each task first,
    so a row that makes up much of the data is no hot key.
    """
    if left.schema.simpleString() != right.select(*left.columns).schema.simpleString():
        raise TypeError(f"{left.schema.simpleString()} is not {right.schema.simpleString()}")
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    return (
        signed.groupBy(*[f"`{c}`" for c in left.columns])
        .agg(F.sum("_sign").alias("surplus"))
        .filter(F.col("surplus") != 0)
    )


def _identity(fields: list[T.StructField]) -> list[Column]:
    """What a row is hashed by. The hash leaves nulls out, so where they are is hashed as well, and
    the size of arrays; deeper values go in as JSON."""
    parts = []
    for field in fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.AtomicType):
            parts += [column, F.size(column), F.transform(column, lambda x: x.isNull())]
        elif isinstance(field.dataType, T.AtomicType):
            parts += [column, column.isNull()]
        else:
            parts.append(F.to_json(F.struct(column), {"ignoreNullFields": "false"}))
    return parts


def _bucket(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*_identity(list(df.schema))), F.lit(BUCKETS)).cast("int")


def bucket_digests(df: DataFrame, buckets: Column | None = None) -> DataFrame:
    """``(bucket, rows, d0, d1, d2, d3)``: rows of each bucket and sums of the halves of two hashes of
    each row, which do not depend on the order of the rows. Sums hold 2^31 rows a bucket. Each task
    sends one row a bucket, so no row of ``df`` is moved."""
    parts = _identity(list(df.schema))
    first, second = F.xxhash64(*parts), F.xxhash64(F.lit("again"), *parts)
    halves = [half for h in (first, second) for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW)))]
    sums = [F.sum(half).alias(f"d{i}") for i, half in enumerate(halves)]
    return df.groupBy(_bucket(df).alias("bucket")).agg(F.count("*").alias("rows"), *sums)


def differing_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """Buckets, ``BUCKETS`` at most, whose digests differ. Equal tables have none; different ones have
    none with a probability of about 2^-100."""
    both = bucket_digests(left).unionByName(bucket_digests(right))
    same = F.struct("rows", "d0", "d1", "d2", "d3")
    odd = both.groupBy("bucket").agg(F.count("*").alias("_sides"), F.count_distinct(same).alias("_kinds"))
    return sorted(r["bucket"] for r in odd.filter("_sides < 2 or _kinds > 1").select("bucket").collect())


def count_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many copies are on one side only.

    Both sides are read for their digests; rows are compared, and moved, only of buckets in which
    these differ. So equal tables are compared without an exchange of their rows.
    """
    if left.schema.simpleString() != right.select(*left.columns).schema.simpleString():
        raise TypeError(f"{left.schema.simpleString()} is not {right.schema.simpleString()}")
    right = right.select(*left.columns)
    odd = differing_buckets(left, right)
    if not odd:
        return left.sparkSession.range(0, 1, 1, 1).select(F.lit(0).cast("long").alias("differences"))
    total = F.coalesce(F.sum(F.abs("surplus")), F.lit(0))
    parts = [side if len(odd) == BUCKETS else side.filter(_bucket(side).isin(odd)) for side in (left, right)]
    return row_differences(*parts).agg(total.alias("differences"))
