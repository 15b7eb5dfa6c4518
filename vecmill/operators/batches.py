"""User functions on Arrow batches of bounded size, and independent task fan-out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

# monotonically_increasing_id() is (partition << 33) + position within the partition.
POSITION_BITS = 33


def batch_rows(batch_size: int | float) -> int:
    """Check a batch size. Whole-valued floats such as 27528.0 are taken."""
    if isinstance(batch_size, bool) or int(batch_size) != batch_size or batch_size <= 0:
        raise ValueError(f"batch size must be a positive whole number, not {batch_size!r}")
    return int(batch_size)


def rechunk(batches: Iterable[pa.RecordBatch], size: int | None) -> Iterator[pa.Table]:
    """Regroup a partition's Arrow batches into tables of ``size`` rows; the last may be smaller.

    Slices are views, so nothing is copied and at most one table is held.
    """
    if size is None:
        for batch in batches:
            yield pa.Table.from_batches([batch])
        return
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, size - rows)
            batch = batch.slice(piece.num_rows)
            held.append(piece)
            rows += piece.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def with_elements(lists: pa.ListArray, elements: pa.Array) -> pa.ListArray:
    """Lists of the same lengths and nulls as ``lists``, filled from flat ``elements``."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, elements, mask=lists.is_null())


def release_memory() -> None:
    """Give free memory of this process back to the system; allocators would keep it for the next task or stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame,
    fn: Callable[[Any], Any],
    batch_size: int | float | None = None,
    schema: T.StructType | str | None = None,
    batch_format: str = "pyarrow",
    profile: Any = None,
) -> DataFrame:
    """Apply ``fn`` to batches of at most ``batch_size`` rows, in parallel and without a shuffle.

    ``fn`` gets a ``pyarrow.Table`` (or a pandas frame with ``batch_format="pandas"``) and returns
    the same kind. It must be row-local: where batches begin depends on the partitioning. Without
    ``schema`` the output schema is taken from ``fn`` applied to zero rows. CPUs per batch are
    ``spark.task.cpus``, or the resource ``profile``.
    """
    if batch_format not in ("pyarrow", "pandas"):
        raise ValueError(f"batch_format must be 'pyarrow' or 'pandas', not {batch_format!r}")
    size = None if batch_size is None else batch_rows(batch_size)
    as_pandas = batch_format == "pandas"
    if schema is None:
        if as_pandas:
            raise ValueError("pandas batches need a schema: types are not known from zero rows")
        schema = from_arrow_schema(fn(to_arrow_schema(df.schema).empty_table()).schema)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rechunk(batches, size):
            if as_pandas:
                result = pa.Table.from_pandas(
                    fn(table.to_pandas()), schema=arrow_schema, preserve_index=False
                )
            else:
                result = fn(table).select(arrow_schema.names).cast(arrow_schema)
            yield from result.to_batches()

    return df.mapInArrow(run, schema, profile=profile)


def chunk_report(df: DataFrame, batch_size: int | float) -> DataFrame:
    """``(partition, batch, rows)`` for the batches that ``map_batches`` forms from ``df``.

    Works on row positions alone, so the scan reads no column.
    """
    size = batch_rows(batch_size)
    slot = F.monotonically_increasing_id()
    position = slot.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        df.select(
            F.shiftright(slot, POSITION_BITS).cast("int").alias("partition"),
            F.call_function("div", position, F.lit(size)).alias("batch"),
        )
        .groupBy("partition", "batch")
        .agg(F.count("*").alias("rows"))
    )


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that is filled by whatever action runs it."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def task_range(spark: SparkSession, n: int, parallelism: int | None = None) -> DataFrame:
    """Task numbers 0..n-1 as column ``id``."""
    return spark.range(0, n, 1, parallelism)


def fan_out(
    tasks: DataFrame,
    fn: Callable[[Any], Any],
    value_type: str = "string",
    parallelism: int | None = None,
) -> DataFrame:
    """Call ``fn`` once for each value in the single column of ``tasks``; results in ``value``.

    ``parallelism`` spreads few but slow tasks over that many partitions.
    """
    if len(tasks.columns) != 1:
        raise ValueError(f"tasks must have one column, not {tasks.columns}")
    if parallelism is not None:
        tasks = tasks.repartition(parallelism)
    schema = T.StructType.fromDDL(f"value {value_type}")
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [fn(task) for task in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(results, arrow_schema.field(0).type)], schema=arrow_schema
            )

    return tasks.mapInArrow(run, schema)
