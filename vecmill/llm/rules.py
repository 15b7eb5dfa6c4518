"""Quality rules with adaptive thresholds (operator 8).

Counts are taken from whole texts in the tasks. The rules compare rates of a document with fences
that come from mergeable quantile sketches of its language and source: each task sketches the rates
it reads, and only sketches are shuffled, so a source that holds a third of all rows is as cheap as
any other. Documents are then filtered by a join with the fences, of which there are as many as
pairs of language and source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import WORD_SPACE, buffers, encoded, map_arrow, segment_sum, slices, strings, words
from vecmill.session import cut_lineage

# The characters of the symbol count.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Rates of a document that is not empty, and how far above the usual range a rate may lie at least,
# where a group varies little.
RATES = {
    "symbol_rate": ("try_divide(n_symbols, word_chars)", 0.05),
    "dup_line_rate": ("try_divide(n_dup_lines, n_words)", 0.05),
    "repeat_rate": ("try_divide(n_repeat_words, n_words)", 0.30),
    "word_length": ("try_divide(word_chars, n_words)", 2.00),
}
FENCE = 3.0
SKETCH_K = 400
# Rates that a group needs for fences of its own.
LEAST_ROWS = 20


def _repeats(codes: np.ndarray, texts: np.ndarray, rows: int) -> np.ndarray:
    """For each word, whether it is in a 3-word window that its text has twice or more."""
    marked = np.zeros(len(codes), bool)
    at = np.flatnonzero(texts[2:] == texts[:-2]) if len(codes) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return marked
    base = int(codes.max()) + 1
    pair = codes[at] * base + codes[at + 1]
    if base**3 * rows < 1 << 63:
        key = (pair * base + codes[at + 2]) * rows + texts[at]
    else:
        _, pair = np.unique(pair, return_inverse=True)
        _, triple = np.unique(pair * base + codes[at + 2], return_inverse=True)
        key = triple * rows + texts[at]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for step in range(3):
        marked[at[twice] + step] = True
    return marked


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(rows, np.int64)
    line_break = data == ord("\n")
    first = line_break.copy()
    first[1:] |= line_break[:-1]
    first[0] = True
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = True
    bounds = np.append(np.flatnonzero(first), len(data))
    text = np.searchsorted(offsets, bounds[:-1], "right") - 1
    held = segment_sum(~WORD_SPACE[data], bounds) > 0
    codes, _ = encoded(strings(data, bounds))
    key = (codes * rows + text)[held]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    return np.bincount(text[held][again], minlength=rows)


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of each text."""
    rows = len(offsets) - 1
    body, bounds, by_text = words(data, offsets)
    n_words = np.diff(by_text)
    repeated = np.zeros(0, bool)
    if len(bounds) > 1:
        codes, _ = encoded(strings(body, bounds))
        repeated = _repeats(codes, np.repeat(np.arange(rows), n_words), rows)
    chars = segment_sum((body & 0xC0) != 0x80, bounds[by_text])
    return [n_words, chars, segment_sum(SYMBOLS[data], offsets), _dup_lines(data, offsets), segment_sum(repeated, by_text)]


def count_texts(docs: DataFrame, id_col: str, text_col: str, groups: tuple[str, ...]) -> DataFrame:
    """``doc_id``, the counts and the group columns of every row; one scan, no shuffle."""
    keys = [F.col(g).cast("string").alias(f"_group{i}") for i, g in enumerate(groups)]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    names = [f"_group{i}" for i in range(len(groups))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        found = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)]
        keep = [batch.column("doc_id"), *[batch.column(n) for n in names]]
        return pa.RecordBatch.from_arrays([*keep, *columns], ["doc_id", *names, *COUNTS])

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} string" for n in names], *[f"{c} long" for c in COUNTS]])
    return map_arrow(source, run, schema)


def fences(counted: DataFrame, names: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """The highest usual rate of each group: the upper quartile and ``FENCE`` times the distance of
    the quartiles, at least the rule's own margin above the upper quartile.

    A group with fewer than ``least`` rates takes the fences of its first name (the language), and those
    of all documents where that has too few too. All levels come from one pass.
    """
    sketches = [F.kll_sketch_agg_double(F.expr(rate).cast("double"), SKETCH_K).alias(r) for r, (rate, _) in RATES.items()]
    rolled = counted.rollup(*names).agg(F.grouping_id().alias("_level"), *sketches)
    highest = []
    for r, (_, margin) in RATES.items():
        n = F.kll_sketch_get_n_double(r)
        enough = n >= F.when(F.col("_level") == (1 << len(names)) - 1, 1).otherwise(least)
        low, high = (F.when(enough, F.kll_sketch_get_quantile_double(r, F.lit(q))) for q in (0.25, 0.75))
        highest.append((high + F.greatest(FENCE * (high - low), F.lit(margin))).alias(r))
    # Sketches draw random bits, so what they say is written once and every row is judged by the same.
    levels = cut_lineage(rolled.select(*names, "_level", *highest), "fences")
    top = levels.where(F.col("_level") == (1 << len(names)) - 1).first()
    parent = levels.where(F.col("_level") == (1 << (len(names) - 1)) - 1)
    parent = parent.select(F.col(names[0]).alias("_parent"), *[F.col(r).alias(f"{r}_parent") for r in RATES])
    joined = levels.where("_level = 0").join(parent, F.col(names[0]).eqNullSafe(F.col("_parent")), "left")
    limits = [F.coalesce(r, f"{r}_parent", F.lit(top[r] if top else None).cast("double")).alias(f"{r}_most") for r in RATES]
    return joined.select(*names, *limits)


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: tuple[str, ...] = ("lang", "source"),
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Counts and verdict of every row.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``. A
    null or empty text has no words and fails. A null language or source is a group of its own.
    Repeated ids are judged row by row. Quartiles of groups of more than ``SKETCH_K`` rates are those of
    a sketch, within about one percent in rank. An empty table gives an empty result.
    """
    names = [f"_group{i}" for i in range(len(groups))]
    counted = cut_lineage(count_texts(docs, id_col, text_col, groups), "rule-counts")
    limits = fences(counted, names).select(*[F.col(n).alias(f"{n}_of") for n in names], "*").drop(*names)
    match = F.lit(True)
    for n in names:
        match &= F.col(n).eqNullSafe(F.col(f"{n}_of"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    usual = F.lit(True)
    for r, (rate, _) in RATES.items():
        usual &= F.coalesce(F.expr(rate) <= F.col(f"{r}_most"), F.lit(True))
    return (
        counted.join(limits, match, "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(usual))
        .select("doc_id", *COUNTS, "base_failed", "kept")
    )
