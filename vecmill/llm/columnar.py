"""Arrow text columns as flat byte arrays, and words as dictionary codes.

Everything works on whole texts. A batch is cut into slices of documents with about
``SLICE_BYTES`` of text, only to bound the memory of a task; a longer document is a slice alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.operators.batches import release_memory

SLICE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096

# The white space of the word pattern [^\x20\x09-\x0D]+.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """``LOWER_ASCII[data]``, faster."""
    return data + (data - np.uint8(65) < 26).view(np.uint8) * np.uint8(32)


def bound_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes, so that long texts do not add up in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


# What the functions of a task keep from one batch to the next.
_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """The object that this task keeps under ``key``, made when it is first asked for."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


@contextmanager
def task_memory() -> Iterator[None]:
    """Workers go on to other tasks: what a task has kept is freed at its end."""
    _KEPT.clear()
    try:
        yield
    finally:
        _KEPT.clear()
        release_memory()


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to one record batch or None."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                if batch.num_rows and (out := function(batch)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def collected(df: DataFrame) -> pd.DataFrame:
    """All rows on the driver, as the arrays that tasks sent: neither the driver's JVM nor its Python holds a row
    as objects, which take many times the room of a model's numbers."""
    return df.toArrow().to_pandas()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
    column = column.cast(pa.large_binary())
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(parts[2], np.uint8) if parts[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of the pieces ``data[bounds[i]:bounds[i + 1]]``, without a copy."""
    data = np.ascontiguousarray(data)
    offsets = np.ascontiguousarray(bounds, np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def encoded(pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of ``pieces``."""
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: their bytes without white space, their bounds in these, and the bounds of
    the texts counted in words. White space never lies inside a UTF-8 character."""
    # As WORD_SPACE has them; whole arrays are compared faster than looked up.
    space = (data == 0x20) | (data - np.uint8(9) <= 4)
    start = ~space
    first = start.copy()
    first[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = start[heads]
    last = start.copy()
    last[:-1] &= space[1:] | first[1:]
    at = np.flatnonzero(first)
    # Sums over words, not over bytes.
    bounds = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - at)])
    return data[start], bounds, np.searchsorted(at, offsets)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
