"""Convolutional text classifier for toxicity (operator 5).

Hashed word embeddings, convolutions of several widths, the maximum of each filter over the whole
text, and a linear layer, trained in numpy on all labelled rows outside the held-out fold: tasks go through
their rows from common parameters, which are then averaged, in a few rounds. A fifth of these rows only
calibrates; scores and thresholds per language, which are reported beside a score that never looks at the
language, come from all rows of that fifth, counted by fine steps of their logit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.bottomk import id_filter
from vecmill.llm.columnar import BATCH_BYTES, LOWER_ASCII, bound_batches, buffers, collected, encoded, map_arrow, slices, strings, task_memory, words
from vecmill.llm.labelled import Adam, bare, hashes, platt, remainder, sigmoid
from vecmill.llm.stages import by_filter
from vecmill.session import cut_lineage

BUCKET_BITS = 22
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 4
BATCH = 64
RATE = 0.01
FOLDS, HELD = 4, 2
# One row in this many calibrates.
CALIBRATES = 5
# Rows that a task steps through between averages, so that a round is long enough to learn in; more rows
# make more tasks.
TASK_ROWS = 4096
# Bound of the embeddings, those of the buckets that tell most about the class (4 MB); not of what is counted.
MOST_BUCKETS = 1 << 17
# Changes of parameters are added up as integers, so that sums do not depend on the order of rows.
DELTA_UNIT = 1 << 30
# Logits are counted by steps of one of these.
LOGIT_STEPS = 4096
CUT = 0.3
SEED = 7


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of the texts, the bucket of each code, and the texts' bounds in words."""
    body, bounds, by_text = words(data, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), by_text
    codes, distinct = encoded(strings(LOWER_ASCII[body], bounds))
    return codes, (hashes(bare(distinct)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), by_text


@dataclass
class Model:
    """Row 0 of ``table`` stands for all words without an embedding and stays zero."""

    known: np.ndarray
    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, bucket: np.ndarray) -> np.ndarray:
        """The row of ``table`` of each bucket."""
        at = np.minimum(np.searchsorted(self.known, bucket), len(self.known) - 1)
        return np.where(self.known[at] == bucket, at + 1, 0) if len(self.known) else np.zeros(len(bucket), np.int64)

    def pooled(self, codes: np.ndarray, rows: np.ndarray, by_text: np.ndarray, where: bool = False):
        """Greatest value of each filter in each text (0 if it has no words), and where it is."""
        texts = len(by_text) - 1
        values = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        places = np.zeros(values.shape, np.int64)
        full = np.flatnonzero(np.diff(by_text) > 0)
        if not len(full):
            return values, places
        last = np.repeat(by_text[1:], np.diff(by_text)) - 1
        for w, (width, kernel) in enumerate(zip(WIDTHS, self.kernels)):
            total = (self.table[rows] @ kernel[0])[codes]
            for step in range(1, width):
                part = (self.table[rows] @ kernel[step])[codes[step:]]
                part[last[: len(part)] < np.arange(len(part)) + step] = 0
                total[: len(part)] += part
            own = slice(w * FILTERS, (w + 1) * FILTERS)
            values[full, own] = np.maximum.reduceat(total, by_text[full], axis=0)
            if where:
                for t in full:
                    places[t, own] = by_text[t] + total[by_text[t] : by_text[t + 1]].argmax(axis=0)
        return values, places

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift[0]

    def limits(self, langs: pa.Array, cut: float) -> np.ndarray:
        """The threshold of each row's language, ``cut`` where there is none."""
        return np.array([self.thresholds.get(lang, cut) for lang in langs.to_pylist()])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, bucket, by_text = buckets(data, offsets)
        logits = self.logits(self.pooled(codes, self.rows(bucket), by_text)[0]).astype(float)
        return sigmoid(self.slope * logits + self.intercept)


def start(known: np.ndarray, count: np.ndarray, ones: np.ndarray, share: float) -> Model:
    """A model with embeddings for the buckets ``known``, in order, which are in ``count`` texts and in ``ones``
    of class 1. Their first component starts at the log-odds of the class where these are significant."""
    rng = np.random.default_rng(SEED)
    sure = np.abs(ones - count * share) > 4 * np.sqrt(count * share * (1 - share))
    odds = np.log((ones + 0.5) / (count - ones + 0.5)) - np.log(share / (1 - share))
    table = np.zeros((len(known) + 1, DIM), np.float32)
    table[1:, 1:] = rng.normal(0, 0.01, (len(known), DIM - 1))
    table[1:, 0] = np.where(sure, np.clip(odds, -3, 3), 0)
    kernels = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[:, 0, 0] = 1.0 / len(kernel)
    size = len(WIDTHS) * FILTERS
    out = rng.normal(0, 0.1, size).astype(np.float32)
    out[::FILTERS] = 1.0
    return Model(known, table, kernels, np.zeros(size, np.float32), out, np.full(1, -2, np.float32))


class RowAdam:
    """Adaptive steps for the rows of a table that a gradient touches; the others stay."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate = table, rate
        self.mean, self.square = np.zeros_like(table), np.zeros_like(table)
        self.steps = np.zeros((len(table), 1), np.float32)

    def update(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        self.steps[rows] += 1
        steps = self.steps[rows]
        mean = self.mean[rows] + 0.1 * (gradient - self.mean[rows])
        square = self.square[rows] + 0.001 * (gradient * gradient - self.square[rows])
        self.mean[rows], self.square[rows] = mean, square
        fix = np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
        self.table[rows] -= self.rate * fix * mean / (np.sqrt(square) + 1e-8)


def train(rows: DataFrame, model: Model, epochs: int = EPOCHS) -> None:
    """Fit ``model`` to all ``rows (label, words)``: each task steps through its own, then every parameter becomes
    the average of the tasks that have changed it, weighted with their rows."""
    size = len(model.table)

    def dense(of: Model) -> np.ndarray:
        flat = np.concatenate([p.ravel() for p in (*of.kernels, of.bias, of.out, of.shift)])
        return np.concatenate([flat, np.zeros(-len(flat) % DIM, np.float32)]).reshape(-1, DIM)

    for epoch in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            with task_memory():
                own = Model(model.known, model.table.copy(), [k.copy() for k in model.kernels], model.bias.copy(), model.out.copy(), model.shift.copy())
                adam, table_adam, seen = Adam([*own.kernels, own.bias, own.out, own.shift], RATE), RowAdam(own.table, RATE), 0
                for some, lists in (piece for batch in batches for piece in word_lists(batch)):
                    labels = some.column("label").to_numpy().astype(float)
                    places = own.rows(lists.flatten().to_numpy().astype(np.int64))
                    ends = np.cumsum(lists.value_lengths().to_numpy())
                    texts = np.split(places, ends[:-1]) if len(ends) else []
                    order = np.random.default_rng([SEED, epoch]).permutation(len(texts))
                    for at in range(0, len(order), BATCH):
                        _step(own, adam, table_adam, [texts[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]])
                    seen += len(texts)
                if not seen:
                    return
                moved = np.flatnonzero(table_adam.steps[:, 0])
                after, before = dense(own), dense(model)
                delta = np.concatenate([own.table[moved] - model.table[moved], after - before]).astype(float)
                units = np.rint(delta * (seen * DELTA_UNIT)).astype(np.int64)
                names = ["row", "seen", *[f"d{i}" for i in range(DIM)]]
                row = np.concatenate([moved, size + np.arange(len(after))])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), seen)), *[pa.array(c) for c in units.T]], names)

        schema = f"row long, seen long, {', '.join(f'd{i} long' for i in range(DIM))}"
        sums = [F.sum(c).alias(c) for c in ("seen", *[f"d{i}" for i in range(DIM)])]
        # One row for each embedding that a task has changed, and some for the other parameters.
        found = collected(rows.select("label", *_words(rows)).mapInArrow(run, schema).groupBy("row").agg(*sums))
        if not len(found):
            return
        change = found[[f"d{i}" for i in range(DIM)]].to_numpy(float) / DELTA_UNIT / found[["seen"]].to_numpy(float)
        row = found["row"].to_numpy(np.int64)
        model.table[row[row < size]] += change[row < size].astype(np.float32)
        flat = np.zeros_like(dense(model))
        flat[row[row >= size] - size] = change[row >= size]
        flat, at = flat.ravel(), 0
        for part in (*model.kernels, model.bias, model.out, model.shift):
            part += flat[at : at + part.size].reshape(part.shape)
            at += part.size


def _step(model: Model, adam: Adam, table_adam: RowAdam, batch: list[np.ndarray], labels: np.ndarray) -> None:
    flat = np.concatenate(batch)
    by_text = np.concatenate([[0], np.cumsum([len(b) for b in batch])])
    distinct, codes = np.unique(flat, return_inverse=True)
    pooled, places = model.pooled(codes, distinct, by_text, where=True)
    active = pooled + model.bias > 0
    hidden = np.where(active, pooled + model.bias, 0)
    error = ((sigmoid(hidden @ model.out + model.shift[0]) - labels) / len(labels)).astype(np.float32)
    back = np.where(active, error[:, None] * model.out, 0)
    back[np.diff(by_text) == 0] = 0
    touched, parts = [], []
    kernels = [np.zeros_like(k) for k in model.kernels]
    ends = by_text[1:, None]
    for w, (width, kernel) in enumerate(zip(WIDTHS, model.kernels)):
        own = slice(w * FILTERS, (w + 1) * FILTERS)
        for step in range(width):
            at = places[:, own] + step
            word = np.where(at < ends, flat[np.minimum(at, max(len(flat) - 1, 0))], 0) if len(flat) else np.zeros_like(at)
            part = np.where(at < ends, back[:, own], 0)
            kernels[w][step] = np.einsum("tf,tfd->df", part, model.table[word])
            touched.append(word.ravel())
            parts.append((part[:, :, None] * kernel[step].T[None]).reshape(-1, DIM))
    touched, parts = np.concatenate(touched), np.concatenate(parts)
    # Row 0 stays zero; what has no part in the error does not move.
    some = (touched > 0) & parts.any(axis=1)
    rows, place = np.unique(touched[some], return_inverse=True)
    gradient = np.stack([np.bincount(place, parts[some, d], len(rows)) for d in range(DIM)], axis=1).astype(np.float32)
    table_adam.update(rows, gradient)
    adam.update([*kernels, back.sum(axis=0), hidden.T @ error + 1e-4 * model.out, np.array([error.sum()])])


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The score that separates the classes with the greatest F1."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    hit, miss = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * hit / (hit + miss + (w * y).sum())
    last = np.append(s[1:] != s[:-1], True)
    place = int(np.argmax(np.where(last, f1, -1)))
    below = s[place + 1] if place + 1 < len(s) else 0.0
    return float((s[place] + below) / 2)


def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(doc_id, lang, n, words)`` of texts: how many words each has, and their buckets, three bytes a word, pressed."""
    data, offsets = buffers(batch.column("text"))
    blobs, counts = [], []
    for a, b in slices(offsets):
        codes, bucket, by_text = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        three = bucket.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3][codes]
        blobs += [zlib.compress(three[first:last].tobytes(), 1) for first, last in zip(by_text[:-1].tolist(), by_text[1:].tolist())]
        counts.append(np.diff(by_text))
    columns = [batch.column("doc_id"), batch.column("lang"), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "n", "words"])


def unpacked(blobs: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """The buckets of all words of each text."""
    three = np.frombuffer(b"".join(zlib.decompress(blob) for blob in blobs.to_pylist()), np.uint8).reshape(-1, 3)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(three @ np.array([1, 1 << 8, 1 << 16], np.int32)))


def word_lists(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """The rows of ``batch`` in pieces, each with the buckets of its texts. Packed buckets may be many more than
    their bytes, so they are unpacked by about as many as a batch holds."""
    if "n" not in batch.schema.names:
        yield batch, batch.column("words")
        return
    counts = batch.column("n").to_numpy()
    for a, b in slices(np.concatenate([[0], np.cumsum(4 * counts)]), BATCH_BYTES):
        some = batch.slice(a, b - a)
        yield some, unpacked(some.column("words"), counts[a:b])


def packed_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``learning_rows`` with packed words and their number ``n``; only these are moved to the labels, never texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", FOLDS) != HELD))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    bound_batches(docs.sparkSession)
    source = docs.where(F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD))
    source = source.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang string, n long, words binary"
    if known.schema["_id"].dataType == source.schema["doc_id"].dataType:
        # What has no label does not move, but for little.
        source = by_filter(source, id_filter(known.select(F.col("_id").alias("doc_id"))), True, then=packed, schema=schema)
    else:
        source = map_arrow(source, packed, schema)
    source = source.join(known, F.col("doc_id") == F.col("_id"))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), F.lit(CALIBRATES)) == 0
    return source.select("lang", "label", part.alias("calibrates"), "n", "words")


def learning_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``(lang, label, calibrates, words)`` of every row of ``docs`` that has a label outside the held-out
    fold; of several labels of one id the largest counts. ``words`` are buckets, and all of the text's."""
    names = ["lang", "label", "calibrates"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                for some, lists in word_lists(batch):
                    yield pa.RecordBatch.from_arrays([*[some.column(n) for n in names], lists], [*names, "words"])

    return packed_rows(docs, labels, label).mapInArrow(run, "lang string, label int, calibrates boolean, words array<int>")


def _words(rows: DataFrame) -> list[str]:
    return [c for c in ("n", "words") if c in rows.columns]


def bucket_counts(rows: DataFrame) -> DataFrame:
    """``(bucket, n, ones)``: the texts that hold a bucket, and those of class 1 among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for some, lists in (piece for batch in batches for piece in word_lists(batch)):
                text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                pairs = np.unique((text << BUCKET_BITS) + lists.flatten().to_numpy())
                bucket, inverse, count = np.unique(pairs & ((1 << BUCKET_BITS) - 1), return_inverse=True, return_counts=True)
                ones = np.bincount(inverse, some.column("label").to_numpy()[pairs >> BUCKET_BITS], len(bucket)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(count), pa.array(ones)], ["bucket", "n", "ones"])

    bound_batches(rows.sparkSession)
    counted = rows.select("label", *_words(rows)).mapInArrow(run, "bucket long, n long, ones long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Train on all labelled rows outside the held-out fold but a fifth of them, which calibrates the
    score and sets the thresholds. Labels whose document is not in ``docs`` do not count: a pipeline trains
    on what its stages have kept."""
    rows = cut_lineage(packed_rows(docs, labels, label), "toxicity-rows", compression="zstd")
    learns = rows.where("not calibrates")
    totals = {r["label"]: r["n"] for r in learns.groupBy("label").agg(F.count("*").alias("n")).collect()}
    every, ones = sum(totals.values()), totals.get(1, 0)
    share = float(np.clip(ones / every if every else 0.5, 0.01, 0.99))
    sure = F.abs(F.col("ones") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    found = collected(bucket_counts(learns).where("n >= 3").orderBy(sure.desc(), "bucket").limit(MOST_BUCKETS)).sort_values("bucket")
    model = start(found["bucket"].to_numpy(np.int64), found["n"].to_numpy(float), found["ones"].to_numpy(float), share)
    if 0 < ones < every:
        train(learns.coalesce(max(every // TASK_ROWS, 1)), model)
    else:
        model.shift[0] = np.log((ones + 0.5) / (every - ones + 0.5)) if every else 0.0
        model.out[:] = 0

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for some, lists in (piece for batch in batches for piece in word_lists(batch)):
                by_text = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                flat = lists.flatten().to_numpy().astype(np.int64)
                values = model.logits(model.pooled(np.arange(len(flat)), model.rows(flat), by_text)[0]).astype(float)
                steps = np.rint(np.clip(values, -100, 100) * LOGIT_STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("label"), pa.array(steps)], ["lang", "label", "step"])

    scored = rows.where("calibrates").select("lang", "label", "n", "words").mapInArrow(logits, "lang string, label int, step long")
    check = collected(scored.groupBy("lang", "label", "step").agg(F.count("*").alias("n")).orderBy("step", "label", "lang"))
    if len(check):
        at, y, weights = check["step"].to_numpy(float) / LOGIT_STEPS, check["label"].to_numpy(float), check["n"].to_numpy(float)
        model.slope, model.intercept = platt(at, y, weights)
        scores = sigmoid(model.slope * at + model.intercept)
        langs = check["lang"].to_numpy(object)
        for lang in {x for x in langs.tolist() if isinstance(x, str)}:
            own = langs == lang
            if weights[own][y[own] == 1].sum() >= 20 and weights[own][y[own] == 0].sum() >= 20:
                model.thresholds[lang] = best_threshold(scores[own], y[own], weights[own])
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` of every whole text; one scan, no shuffle.

    A null or empty text gets the score of a text without words. ``flagged`` compares the score with
    the threshold of the row's language, or with ``cut`` where there is none.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        scores = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        columns = [batch.column("doc_id"), batch.column("lang"), pa.array(np.concatenate(scores))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    limit = F.lit(cut)
    for lang, threshold in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, threshold).otherwise(limit)
    return map_arrow(source, run, f"doc_id {kind}, lang string, score double").select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        (F.col("score") >= limit).alias("flagged"),
    )
