"""Filters of whole rows for the pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.bottomk import FILTER_WORDS, id_filter
from vecmill.llm.columnar import buffers, map_arrow, slices, task_memory
from vecmill.session import cut_lineage


def keep_rows(docs: DataFrame, keep: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray], text_col: str = "text") -> DataFrame:
    """Rows for which ``keep(bytes, offsets, rows)`` is true; one scan, no shuffle, all columns."""
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column(place))
        kept = [keep(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.slice(a, b - a)) for a, b in slices(offsets)]
        return batch.filter(pa.array(np.concatenate(kept)))

    return map_arrow(docs, run, docs.schema)


def by_filter(
    docs: DataFrame, bits: np.ndarray, maybe: bool, id_col: str = "doc_id", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None
) -> DataFrame:
    """Rows whose id may be one of those that ``bits`` was made from, or rows whose id is none. ``then`` turns those
    that pass into rows of ``schema`` in the same worker."""
    word, bit = F.pmod(F.xxhash64(id_col), F.lit(FILTER_WORDS)), F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(64))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                hit = (bits[batch.column("_word").to_numpy()] >> batch.column("_bit").to_numpy()) & 1
                passed = batch.select(names).filter(pa.array(hit == int(maybe)))
                if passed.num_rows:
                    yield then(passed) if then else passed

    return docs.select(*names, word.alias("_word"), bit.alias("_bit")).mapInArrow(run, schema or docs.schema)


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not in ``dropped``. Most rows pass by a filter of bounded size and are not
    moved; only those that may be in ``dropped`` are joined with it."""
    # Asked twice, for the filter and for the join, but made once.
    dropped = cut_lineage(dropped.select("doc_id").distinct(), "dropped-ids")
    bits = id_filter(dropped)
    doubtful = by_filter(docs, bits, True, id_col).join(dropped.withColumnRenamed("doc_id", "_dropped"), F.col(id_col) == F.col("_dropped"), "left_anti")
    return by_filter(docs, bits, False, id_col).unionByName(doubtful)
