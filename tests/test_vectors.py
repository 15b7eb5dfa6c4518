import decimal
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import plan_of
from vecmill.functions.vectors import append_scaled, argmax, cast_elements


def frame(spark, element, *vectors):
    return spark.createDataFrame([(v,) for v in vectors], f"vector array<{element}>")


def scaled(df, **options):
    return [r["vector_x2"] for r in append_scaled(df, **options).collect()]


def test_ragged_integers(spark):
    df = frame(spark, "bigint", [1, 2, 3], [4, 5], [6])
    out = append_scaled(df)
    assert out.columns == ["vector", "vector_x2"]
    assert scaled(df) == [[2, 4, 6], [8, 10], [12]]
    assert out.count() == df.count()


@pytest.mark.parametrize("element", ["tinyint", "smallint", "int", "bigint", "float", "double"])
def test_element_type_is_kept(spark, element):
    out = append_scaled(frame(spark, element, [1, 2]) if "int" in element else frame(spark, element, [1.0, 2.0]))
    assert dict(out.dtypes)["vector_x2"] == f"array<{element}>"
    assert [list(map(float, r["vector_x2"])) for r in out.collect()] == [[2.0, 4.0]]


def test_decimal_type_is_kept(spark):
    df = frame(spark, "decimal(10,2)", [decimal.Decimal("1.25")])
    assert dict(append_scaled(df).dtypes)["vector_x2"] == "array<decimal(10,2)>"
    assert scaled(df) == [[decimal.Decimal("2.50")]]


def test_float_overflow_is_infinite(spark):
    assert scaled(frame(spark, "float", [3.0e38, -3.0e38])) == [[math.inf, -math.inf]]


def test_nan_infinity_and_negative_zero(spark):
    (out,) = scaled(frame(spark, "double", [math.nan, -math.inf, -0.0]))
    assert math.isnan(out[0]) and out[1] == -math.inf
    assert math.copysign(1.0, out[2]) == -1.0


@pytest.mark.parametrize(
    "element,value",
    [("tinyint", 100), ("smallint", 20_000), ("int", 2**30), ("bigint", 2**62)],
)
def test_integer_overflow_fails(spark, element, value):
    with pytest.raises((PySparkException, Exception), match="OVERFLOW"):
        scaled(frame(spark, element, [value]))


def test_decimal_overflow_fails(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        scaled(frame(spark, "decimal(3,0)", [decimal.Decimal(600)]))


def test_overflow_needs_ansi(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.ansi.enabled", "false")
    with pytest.raises(RuntimeError, match="ansi"):
        append_scaled(frame(other, "int", [1]))
    assert scaled(frame(other, "float", [1.5])) == [[3.0]]


def test_empty_lists_and_tables(spark):
    assert scaled(frame(spark, "float", [])) == [[]]
    assert append_scaled(frame(spark, "float", [1.0]).limit(0)).count() == 0


def test_nulls_pass_by_default(spark):
    assert scaled(frame(spark, "float", None, [1.0, None])) == [None, [2.0, None]]


@pytest.mark.parametrize("vector", [None, [1.0, None]])
def test_nulls_can_fail(spark, vector):
    with pytest.raises(Exception, match="null list or null element"):
        scaled(frame(spark, "float", vector), on_null="fail")
    assert scaled(frame(spark, "float", [1.0]), on_null="fail") == [[2.0]]


@pytest.mark.parametrize("element", ["string", "boolean", "array<int>"])
def test_other_elements_are_rejected(spark, element):
    with pytest.raises(TypeError):
        append_scaled(frame(spark, element))


def test_output_must_be_new(spark):
    df = append_scaled(frame(spark, "float", [1.0]))
    with pytest.raises(ValueError, match="exists"):
        append_scaled(df)
    assert scaled(df, replace=True) == [[2.0]]


def test_missing_column(spark):
    with pytest.raises(ValueError, match="no column"):
        append_scaled(spark.range(1))


def test_other_columns_are_kept_in_order(spark):
    df = spark.createDataFrame([(1, [1.0], "a")], "id int, vector array<float>, note string")
    assert append_scaled(df).columns == ["id", "vector", "note", "vector_x2"]


def test_via_float32(spark):
    ((tenth,),) = scaled(frame(spark, "double", [0.1]), via="float32")
    assert tenth == 0.20000000298023224
    assert scaled(frame(spark, "bigint", [16_777_216, -3]), via="float32") == [[33_554_432, -6]]
    # Only the input is rounded to float32, the product is not.
    assert scaled(frame(spark, "double", [2.0**127]), via="float32") == [[2.0**128]]


def test_via_float32_inexact_integer(spark):
    with pytest.raises(Exception, match="does not fit float32"):
        scaled(frame(spark, "bigint", [16_777_217]), via="float32")


def test_no_shuffle_and_no_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = plan_of(append_scaled(df, "embedding"))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_only_used_columns_are_read(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = plan_of(append_scaled(df, "embedding").select("embedding_x2"))
    assert "ReadSchema: struct<embedding:array<float>>" in plan


def test_argmax(spark):
    df = frame(spark, "double", [1.0, 3.0, 3.0], [2.0, math.nan], [], None, [None, 5.0])
    assert [r[0] for r in df.select(argmax("vector")).collect()] == [1, 1, None, None, 1]


def test_cast_elements(spark):
    out = cast_elements(frame(spark, "double", [0.1]), "vector", "float")
    assert dict(out.dtypes)["vector"] == "array<float>"
    assert out.select(F.col("vector")[0].cast("double")).first()[0] == 0.10000000149011612
