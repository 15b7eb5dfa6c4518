import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from vecmill.functions.vectors import append_scaled
from vecmill.operators.batches import (
    batch_rows,
    chunk_report,
    fan_out,
    map_batches,
    observe_rows,
    rechunk,
    task_range,
)
from vecmill.operators.parity import count_differences, row_differences
from vecmill.plans.jobs import double_batch


def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")


@pytest.mark.parametrize("size", [1, 7, 128, 27528.0])
@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_same_result_for_any_batching(spark, sf_dir, size, partitions):
    df = corpus(spark, sf_dir)
    batched = map_batches(df.repartition(partitions), double_batch(), size)
    assert batched.schema.simpleString() == append_scaled(df).schema.simpleString()
    assert count_differences(append_scaled(df), batched).first()[0] == 0


def test_batches_stay_within_size(spark):
    sizes = map_batches(
        spark.range(0, 500, 1, 3), lambda t: pa.table({"n": [t.num_rows]}), 64, "n long"
    )
    got = [r["n"] for r in sizes.collect()]
    assert sum(got) == 500 and max(got) == 64
    report = chunk_report(spark.range(0, 500, 1, 3), 64)
    assert sorted(r["rows"] for r in report.collect()) == sorted(got)
    assert {(r["partition"], r["batch"]) for r in report.collect()} == {
        (p, b) for p in range(3) for b in range(3)
    }


def test_batches_larger_than_the_arrow_default(spark):
    sizes = map_batches(
        spark.range(0, 30_000, 1, 1), lambda t: pa.table({"n": [t.num_rows]}), 25_000, "n long"
    )
    assert [r["n"] for r in sizes.collect()] == [25_000, 5_000]


@pytest.mark.parametrize("size", [0, -1, 2.5, True])
def test_bad_batch_size(size):
    with pytest.raises(ValueError):
        batch_rows(size)


def test_rechunk_is_exact():
    batches = [pa.record_batch({"x": list(range(n))}) for n in (3, 0, 10, 1)]
    tables = list(rechunk(batches, 4))
    assert [t.num_rows for t in tables] == [4, 4, 4, 2]
    assert pa.concat_tables(tables)["x"].to_pylist() == [x for b in batches for x in b["x"].to_pylist()]


def test_arrow_function_handles_nulls_and_slices(spark):
    rows = [([1.0, None],), (None,), ([],), ([2.0],)]
    df = spark.createDataFrame(rows, "vector array<float>").coalesce(1)
    got = [r["vector_x2"] for r in map_batches(df, double_batch(), 3).collect()]
    assert got == [[2.0, None], None, [], [4.0]]


def test_schema_is_taken_from_no_rows(spark):
    out = map_batches(spark.range(3), lambda t: t.append_column("y", t["id"]))
    assert out.dtypes == [("id", "bigint"), ("y", "bigint")]


def test_pandas_batches(spark):
    out = map_batches(
        spark.range(5), lambda p: p.assign(y=p.id * 2), 2, "id long, y long", batch_format="pandas"
    )
    assert rows_of(out) == [(i, 2 * i) for i in range(5)]
    with pytest.raises(ValueError, match="schema"):
        map_batches(spark.range(5), lambda p: p, batch_format="pandas")


def test_map_batches_has_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plan_of(map_batches(corpus(spark, sf_dir), double_batch(), 128))


def test_fan_out(spark):
    out = fan_out(task_range(spark, 1000, 16), lambda n: n % 16, "long")
    assert out.count() == 1000
    assert rows_of(out.distinct()) == sorted(((i,) for i in range(16)), key=repr)
    assert fan_out(task_range(spark, 10), str, parallelism=4).rdd.getNumPartitions() == 4


def test_observed_rows(spark, sf_dir):
    counted, observation = observe_rows(corpus(spark, sf_dir), "seen")
    counted.write.format("noop").mode("overwrite").save()
    assert observation.get["rows"] == 500


def test_row_differences_count_copies(spark):
    left = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [2.0])], "k int, v array<double>")
    right = spark.createDataFrame([(1, [1.0]), (3, [3.0])], "k int, v array<double>")
    assert rows_of(row_differences(left, right)) == [(1, [1.0], 1), (2, [2.0], 1), (3, [3.0], -1)]
    assert count_differences(left, right).first()[0] == 3
    assert count_differences(left, left).first()[0] == 0
    with pytest.raises(TypeError):
        row_differences(left, right.withColumn("k", F.col("k").cast("long")))
