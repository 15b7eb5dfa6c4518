"""Quality classifier on random-indexing word vectors (operator 6).

Every word has a sparse random index vector, drawn from its hash. The vector of a word is its own index
vector and the sum of those of the words up to two places beside it, over the whole corpus, rare
neighbours counting more. Words are counted first: the most frequent, a bounded number, have a vector
each, the others one for each of 2,048 hashed spellings. Tasks add up what they read; only the sums are
shuffled. A document is the mean and the spread of its words' vectors and the mean index vector of
their shapes (letters, digits and signs, runs joined), with its size and its share of repeated words; a
two-layer numpy network with a fitted temperature scores it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import bound_batches, buffers, collected, encoded, id_text, map_arrow, slices, spread_ranges, strings, task_memory, words
from vecmill.llm.labelled import Adam, class_totals, hashes, platt, remainder, sample_ids, sigmoid
from vecmill.session import cut_lineage

# Bound of the words with a vector of their own, so that a task can hold them all (4 MB).
WORDS = 1 << 15
# Words are told apart for it by steps of a sixteenth of a power of two in their count.
STEPS = 16
UNIT_BITS = 11
UNITS = 1 << UNIT_BITS
DIM = 32
NONZERO = 4
WINDOW = (-2, -1, 1, 2)
# Positions whose contexts are added up at a time, which bounds the memory for a long text.
CHUNK = 1 << 17
# Words of a text that are added up at a time, and how many a text needs for sums of its own.
SUM_WORDS, LONG = 1 << 13, 24
HIDDEN = 32
EPOCHS = 60
BATCH = 128
RATE = 0.003
FOLDS, HELD = 5, 0
# Bound of the training sample: rows of each class.
SAMPLE_ROWS = 4000
CUT = 0.3
SEED = 11


def index_vectors(hashed: np.ndarray) -> np.ndarray:
    """Sparse random vectors: ``NONZERO`` times +1 or -1 at places that the hash names."""
    out = np.zeros((len(hashed), DIM), np.float32)
    rows = np.arange(len(hashed))
    for j in range(NONZERO):
        place = (hashed >> np.uint64(8 * j + 5)).astype(np.int64) % DIM
        out[rows, place] += np.where((hashed >> np.uint64(44 + j)) & np.uint64(1), np.float32(1), np.float32(-1))
    return out


SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[128:] = ord("a")
SHAPE[ord("0") : ord("9") + 1] = ord("0")


def shapes(distinct: pa.Array) -> pa.Array:
    """Words with runs of capitals, other letters, digits and equal signs as one character each."""
    data, bounds = buffers(distinct.cast(pa.large_binary()))
    kinds = SHAPE[data]
    kept = np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)]
    kept[bounds[:-1]] = True
    total = np.concatenate([[0], np.cumsum(kept)])
    return strings(kinds[kept], total[bounds])


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words, the distinct words, and the texts' bounds in words."""
    body, bounds, by_text = words(data, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), by_text
    return *encoded(strings(body, bounds)), by_text


def _bits(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - UNIT_BITS)).astype(np.int64)


@dataclass
class Words:
    """Hashes of the frequent words in order, and how much each counts as a neighbour."""

    known: np.ndarray
    weights: np.ndarray
    most: float

    def of(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word's vector and its weight as a neighbour, a whole number."""
        rows = len(self.known) + _bits(hashed)
        if not len(self.known):
            return rows, np.full(len(hashed), self.most, np.float32)
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        same = self.known[at] == hashed
        return np.where(same, at, rows), np.where(same, self.weights[at], self.most).astype(np.float32)


def frequent_words(docs: DataFrame) -> Words:
    """At most ``WORDS`` words, those of the highest counts in the whole corpus."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                data, offsets = buffers(batch.column("text"))
                for a, b in slices(offsets):
                    codes, distinct, _ = spelled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if len(codes):
                        yield pa.RecordBatch.from_arrays([pa.array(hashes(distinct).view(np.int64)), pa.array(np.bincount(codes))], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    counts = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")), "quality-words")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    # A few hundred steps whatever the corpus.
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("size"), F.sum("n").alias("n")).toPandas()
    steps = steps.sort_values("step", ascending=False)
    some = int(np.searchsorted(np.cumsum(steps["size"].to_numpy(int)), WORDS, "right"))
    least = int(steps["step"].iloc[some - 1]) if some else 1 << 30
    top = collected(counts.where(step >= least))
    known = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    total = max(float(steps["n"].sum()), 1.0)
    return Words(known[order], np.round(np.log2(total / top["n"].to_numpy(float)))[order] + 1, np.round(np.log2(total)) + 1)


def contexts(codes: np.ndarray, hashed: np.ndarray, by_text: np.ndarray, of: Words, total: np.ndarray) -> None:
    """Add to the rows of ``total`` the weighted index vectors of the words beside each position."""
    rows, weights = of.of(hashed)
    # A row for each dimension, so that shifts and sums run along the positions.
    index = np.ascontiguousarray((index_vectors(hashed) * weights[:, None]).T)
    own, text = rows[codes], np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
    margin = max(WINDOW)
    for first in range(0, len(codes), CHUNK):
        last = min(first + CHUNK, len(codes))
        low, high = max(first - margin, 0), min(last + margin, len(codes))
        # Empty places between the texts keep their words apart.
        place = np.arange(low, high) + margin * (text[low:high] - text[low] + 1)
        spaced = np.zeros((DIM, int(place[-1]) - low + 1 + margin), np.float32)
        spaced[:, place - low] = index[:, codes[low:high]]
        beside = np.zeros_like(spaced)
        inner = slice(margin, spaced.shape[1] - margin)
        for offset in WINDOW:
            beside[:, inner] += spaced[:, margin + offset : spaced.shape[1] - margin + offset]
        at = place[first - low : last - low] - low
        used, row = np.unique(own[first:last], return_inverse=True)
        # Whole numbers below 2^24, so that no sum depends on an order.
        for d in range(DIM):
            total[used, d] += np.bincount(row, beside[d, at], len(used))


@dataclass
class Vectors:
    words: Words
    table: np.ndarray

    def of(self, distinct: pa.Array) -> np.ndarray:
        """Vectors of distinct words: their own index vectors beside their contexts."""
        hashed = hashes(distinct)
        return index_vectors(hashed) / np.float32(np.sqrt(NONZERO)) + self.table[self.words.of(hashed)[0]]


def word_vectors(docs: DataFrame) -> Vectors:
    """Contexts of all words from all documents, each scaled to length 1."""
    of = frequent_words(docs)
    size = len(of.known) + UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            total = np.zeros((size, DIM))
            for batch in batches:
                data, offsets = buffers(batch.column("text"))
                for a, b in slices(offsets):
                    codes, distinct, by_text = spelled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if len(codes):
                        contexts(codes, hashes(distinct), by_text, of, total)
            used = np.flatnonzero(total.any(axis=1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total[used].astype(np.int64).ravel()), DIM).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), lists], ["unit", "sums"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "unit long, sums array<long>")
    # One row for each of at most ``WORDS + UNITS`` vectors.
    found = collected(parts.groupBy("unit").agg(*[F.sum(F.col("sums")[i]).alias(f"d{i}") for i in range(DIM)]))
    table = np.zeros((size, DIM))
    if len(found):
        table[found["unit"].to_numpy(int)] = found[[f"d{i}" for i in range(DIM)]].to_numpy(float)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return Vectors(of, (table / np.where(length > 0, length, 1)).astype(np.float32))


def pooled(vectors: Vectors, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each whole text; a text without words has zeros."""
    codes, distinct, by_text = spelled(data, offsets)
    rows = len(offsets) - 1
    count = np.diff(by_text)
    out = np.zeros((rows, 3 * DIM + 4), np.float32)
    if not len(codes):
        return out
    text = np.repeat(np.arange(rows), count)
    some = np.maximum(count, 1)[:, None]
    shape_codes, shape_words = encoded(shapes(distinct))
    shaped = (index_vectors(hashes(shape_words)) / np.float32(np.sqrt(NONZERO)))[shape_codes]
    each = np.concatenate([vectors.of(distinct), shaped], axis=1)
    each = np.concatenate([each, each[:, DIM:] ** 2], axis=1)
    sums = _text_sums(each, codes, by_text)
    mean, square = sums[:, : 2 * DIM] / some, sums[:, 2 * DIM :] / some
    out[:, : 2 * DIM] = mean
    out[:, 2 * DIM : 3 * DIM] = np.sqrt(np.maximum(square - mean[:, DIM:] ** 2, 0))
    different = np.sort(text * len(distinct) + codes)
    seen = np.bincount(different[np.append(True, different[1:] != different[:-1])] // len(distinct), minlength=rows)
    again = np.bincount(text[1:][(codes[1:] == codes[:-1]) & (text[1:] == text[:-1])], minlength=rows)
    triples = _repeated_triples(codes, text, rows)
    out[:, 3 * DIM] = np.log1p(count) / 5
    out[:, 3 * DIM + 1] = seen / some[:, 0]
    out[:, 3 * DIM + 2] = again / some[:, 0]
    out[:, 3 * DIM + 3] = triples / some[:, 0]
    return out


def _text_sums(each: np.ndarray, codes: np.ndarray, by_text: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``each`` over the words of each text."""
    sums, count = np.zeros((len(by_text) - 1, each.shape[1])), np.diff(by_text)
    ones = np.ones(SUM_WORDS, np.float32)
    # Words of a text meet in any number of pieces, so a long text needs no more memory.
    for t in np.flatnonzero(count >= LONG).tolist():
        for first in range(by_text[t], by_text[t + 1], SUM_WORDS):
            own = each[codes[first : min(first + SUM_WORDS, by_text[t + 1])]]
            sums[t] += ones[: len(own)] @ own
    short = np.flatnonzero((count > 0) & (count < LONG))
    if len(short):
        place = spread_ranges(by_text[short], count[short])
        ends = np.cumsum(count[short])
        for a, b in slices(np.append(0, ends), CHUNK):
            begin = ends[a] - count[short[a]]
            sums[short[a:b]] = np.add.reduceat(each[codes[place[begin : ends[b - 1]]]], ends[a:b] - count[short[a:b]] - begin, axis=0)
    return sums


def _repeated_triples(codes: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """How many words of each text begin three words that it has had before."""
    if len(codes) < 3:
        return np.zeros(rows, np.int64)
    inside = np.flatnonzero(text[2:] == text[:-2])
    whose, words_of, bits = text[inside], int(codes.max()) + 1, max(int(rows - 1).bit_length(), 1)
    first, second, third = (codes[inside + i].astype(np.uint64) for i in range(3))
    if rows * words_of**3 < 1 << 63:
        key = (first * np.uint64(words_of) + second) * np.uint64(words_of) + third
        width = np.uint64(words_of**3)
        key += whose.astype(np.uint64) * width
        key.sort()
        owner = key // width
    else:
        key = first * np.uint64(0x9E3779B97F4A7C15) + second
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + third
        key = ((key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(bits)
        key |= whose.astype(np.uint64) << np.uint64(64 - bits)
        key.sort()
        owner = key >> np.uint64(64 - bits)
    return np.bincount(owner[1:][key[1:] == key[:-1]].astype(np.int64), minlength=rows)


@dataclass
class Model:
    vectors: Vectors
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]).astype(float)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(pooled(self.vectors, data, offsets)) / self.temperature)


def train(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, vectors: Vectors, epochs: int = EPOCHS) -> Model:
    """The network, by Adam with a little weight decay."""
    rng = np.random.default_rng(SEED)
    mean = features.mean(axis=0) if len(features) else np.zeros(3 * DIM + 4, np.float32)
    scale = features.std(axis=0) + 0.05 if len(features) else np.ones(3 * DIM + 4, np.float32)
    size = 3 * DIM + 4
    w1 = rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN))
    w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    model = Model(vectors, mean, scale, [w1, np.zeros(HIDDEN), w2, np.zeros(1)])
    adam = Adam(model.weights, RATE)
    x, y = (features - mean) / scale, labels.astype(float)
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            hidden = np.tanh(x[own] @ w1 + model.weights[1])
            error = weights[own] * (sigmoid(hidden @ model.weights[2] + model.weights[3][0]) - y[own]) / max(weights[own].sum(), 1e-9)
            back = error[:, None] * model.weights[2] * (1 - hidden * hidden)
            adam.update([
                x[own].T @ back + 1e-3 * w1, back.sum(axis=0),
                hidden.T @ error + 1e-3 * model.weights[2], np.array([error.sum()]),
            ])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all documents; the network and its temperature from at most ``sample_rows``
    labelled rows of each class, a fifth of which only sets the temperature."""
    vectors = word_vectors(docs)
    chosen = sample_ids(labels, label, FOLDS, HELD, sample_rows)
    source = id_text(docs).join(F.broadcast(chosen), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        rows = np.concatenate([pooled(vectors, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "features"])

    kind = source.schema["doc_id"].dataType.simpleString()
    found = collected(map_arrow(source, run, f"doc_id {kind}, label int, features array<float>"))
    found = found.sort_values(["doc_id", "label"], kind="stable").drop_duplicates("doc_id")
    totals = class_totals(labels, label, FOLDS, HELD)
    y = found["label"].to_numpy(int)
    x = np.stack(found["features"].to_numpy()).astype(np.float32) if len(found) else np.zeros((0, 3 * DIM + 4), np.float32)
    # Rows of a class that was cut to the bound count for those left out.
    weights = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weights[y == c] = max(totals.get(c, 1) / sample_rows, 1.0)
    weights /= weights.mean() if len(weights) else 1.0
    fold = np.arange(len(y)) % 5 == 0
    model = train(x[~fold], y[~fold], weights[~fold], vectors)
    if fold.any():
        slope, _ = platt(model.logits(x[fold]), y[fold].astype(float), weights[fold], slope_only=True)
        model.temperature = 1 / slope
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; one scan, no shuffle.

    A null or empty text gets the score of a text without words. Repeated ids are scored row by row.
    """
    source = id_text(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        scores = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, score double").select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
