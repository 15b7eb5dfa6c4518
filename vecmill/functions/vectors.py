"""Element-wise work on array columns that keeps the element type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def element_type(df: DataFrame, column: str) -> T.DataType:
    """Element type of a numeric array column; anything else is rejected before a job starts."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} in {df.columns}")
    array = df.schema[column].dataType
    if not isinstance(array, T.ArrayType):
        raise TypeError(f"{column!r} is {array.simpleString()}, not an array")
    element = array.elementType
    if not isinstance(element, INTEGRAL + FRACTIONAL + (T.DecimalType,)):
        raise TypeError(f"{column!r} holds {element.simpleString()}, not numbers")
    return element


def scaled(column: str, element: T.DataType, factor: int | float = 2) -> Column:
    """``factor`` times every element, still of type ``element``.

    The factor is a literal of the element type: an untyped one would widen float to double and
    tinyint to int. Decimals always widen in a product, so they are cast back.
    """
    vector = F.col(column)
    if isinstance(element, T.DecimalType):
        return F.transform(vector, lambda x: (x * F.lit(factor)).cast(element))
    if isinstance(element, INTEGRAL):
        if int(factor) != factor:
            raise ValueError(f"factor {factor} would not keep {element.simpleString()} elements")
        factor = int(factor)
    return F.transform(vector, lambda x: x * F.lit(factor).cast(element))


def scaled_via_float32(column: str, element: T.DataType, factor: int | float = 2) -> Column:
    """As ``scaled``, for elements first rounded to float32; the result has the source type.

    Integers that float32 cannot hold are an error, since rounding them would go unnoticed.
    """
    vector = F.col(column)
    if isinstance(element, T.DecimalType):
        raise TypeError("decimal elements cannot come back from float32")
    if isinstance(element, INTEGRAL):
        message = F.lit(f"{column}: integer element does not fit float32")
        inexact = F.exists(
            vector, lambda x: x.cast("float").cast("decimal(38,0)") != x.cast("decimal(38,0)")
        )
        return F.when(inexact, F.raise_error(message)).otherwise(scaled(column, element, factor))
    # Only the input is rounded: the product is taken in the source type and so cannot overflow
    # float32 when the source is double.
    return F.transform(
        vector.cast("array<float>"), lambda x: x.cast(element) * F.lit(factor).cast(element)
    )


def append_scaled(
    df: DataFrame,
    column: str = "vector",
    output: str | None = None,
    factor: int | float = 2,
    via: str | None = None,
    on_null: str = "propagate",
    replace: bool = False,
) -> DataFrame:
    """Append ``output`` (``<column>_x2`` for factor 2) and keep all other columns.

    A projection only: no shuffle, no Python. ``via="float32"`` rounds the input to float32
    first. ``on_null="fail"`` makes a null list or a null element fail the job; the default lets
    nulls through, as Spark expressions do. Integer and decimal overflow is an error, NaN,
    infinities and the sign of zero are kept.
    """
    if via not in (None, "float32"):
        raise ValueError(f"via must be None or 'float32', not {via!r}")
    if on_null not in ("propagate", "fail"):
        raise ValueError(f"on_null must be 'propagate' or 'fail', not {on_null!r}")
    element = element_type(df, column)
    output = output or f"{column}_x{factor}"
    if output in df.columns and not replace:
        raise ValueError(f"column {output!r} exists; pass replace=True to overwrite it")
    if not isinstance(element, FRACTIONAL):
        ansi = df.sparkSession.conf.get("spark.sql.ansi.enabled")
        if ansi.lower() != "true":
            raise RuntimeError("spark.sql.ansi.enabled must be on, or overflow would wrap silently")

    build = scaled_via_float32 if via else scaled
    result = build(column, element, factor)
    if on_null == "fail":
        vector = F.col(column)
        has_null = vector.isNull() | F.exists(vector, lambda x: x.isNull())
        result = F.when(
            has_null, F.raise_error(F.lit(f"{column}: null list or null element"))
        ).otherwise(result)
    return df.withColumn(output, result)


def cast_elements(df: DataFrame, column: str, to: str) -> DataFrame:
    """Cast the elements of an array column, e.g. ``to="float"``."""
    element_type(df, column)
    return df.withColumn(column, F.col(column).cast(f"array<{to}>"))


def argmax(column: str) -> Column:
    """Zero-based index of the largest element, the first on ties; NaN counts as largest.

    Null for an empty array.
    """
    vector = F.col(column)
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def plain_encoding(df: DataFrame) -> dict[str, str]:
    """Parquet write options for columns of float or double arrays: no attempt at a dictionary.

    Embeddings hardly repeat, so the writer would build one, outgrow it and start again; without
    it the same bytes are written in about half the time.
    """
    return {
        f"parquet.enable.dictionary#{field.name}.list.element": "false"
        for field in df.schema
        if isinstance(field.dataType, T.ArrayType)
        and isinstance(field.dataType.elementType, FRACTIONAL)
    }
