"""Masked pseudo-likelihood scores (operator 10).

A bidirectional window network predicts every word from the words on both sides; the sum of the
conditional log-probabilities of a document is its score. All words are counted over the whole corpus.
The number of classes that the network predicts grows with the corpus: frequent words have a class
each, the others share some by hash, and within such a class each has the part that its own count gives.
The network is trained in numpy on every position of all documents: each task goes through its own from
common parameters, and these are averaged, weighted with the positions seen, in a few rounds.

So the scores depend on how the scan is cut into tasks, as averaged training does; they are the same for the same cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import BATCH_BYTES, bound_batches, buffers, collected, encoded, id_text, lowered, map_arrow, segment_sum, slices, strings, task_memory, words
from vecmill.llm.labelled import hashes
from vecmill.session import cut_lineage

# Classes are about the square root of the words of the corpus, a power of two, so that the parameters
# stay small beside the texts of a task. Their limit bounds the model (8 MB), not what is counted.
LEAST_CLASSES = 2048
MOST_CLASSES = 1 << 16
# One class in this many is shared by words without one of their own.
TAIL_SHARE = 32
# Words whose counts every task holds; the counts of the others are joined.
HEAD = 1 << 18
# Words are told apart for the head by steps of a sixteenth of a power of two.
STEPS = 16
OFFSETS = (-2, -1, 1, 2)
DIM = 16
HIDDEN = 16
# Every position of every document is a training example of one of the rounds.
ROUNDS = 2
BATCH = 4096
# Rows whose logits stay in a core's cache.
SOME = 512
RATE = 0.1
SEED = 13
# Sums of exponentials of logits up to this keep single precision without a shift.
LARGEST_LOGIT = 60.0
BLOCK = 32
# Logarithms of counts are added up as integers, so that sums do not depend on the order of rows.
LOG_UNIT = 1e9


@dataclass
class Lookup:
    """What each task holds: hashes of the head words in order, their classes and the logarithms of
    their parts of these; the logarithms of the words of each class."""

    head: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    totals: np.ndarray

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Where each word is among the head words, if it is one. Sorted words are found faster."""
        order = np.argsort(hashed)
        at = np.empty(len(hashed), np.int64)
        at[order] = np.minimum(np.searchsorted(self.head, hashed[order]), len(self.head) - 1)
        return at

    def of(self, hashed: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and whether it is a head word; ``at`` are its ``places``."""
        count = len(self.totals)
        tail = count - count // TAIL_SHARE + (hashed % (count // TAIL_SHARE)).astype(np.int64)
        if not len(self.head):
            return tail, np.zeros(len(hashed), bool)
        at = self.places(hashed) if at is None else at
        found = self.head[at] == hashed
        return np.where(found, self.classes[at], tail), found

    def part(self, at: np.ndarray, classes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Logarithm of the part of its class of each word at ``places``; for one that is no head word, as if
        it occurred once."""
        if not len(self.head):
            return -self.totals[classes]
        return np.where(found, self.parts[at], -self.totals[classes])


@dataclass
class Vocabulary:
    """The lookup, the words of each class, and the counts above 1 of words outside the head."""

    lookup: Lookup
    totals: np.ndarray
    rare: DataFrame | None


def shape_of(classes: int) -> tuple[int, int]:
    """Groups of classes, and classes in each: a probability is that of a group and of a class in it."""
    width = 1 << (classes.bit_length() // 2)
    return classes // width, width


def _hashed(data: np.ndarray, offsets: np.ndarray):
    body, bounds, by_text = words(data, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), by_text
    codes, distinct = encoded(strings(lowered(body), bounds))
    return codes, (hashes(distinct) >> np.uint64(1)).astype(np.int64), by_text


def _step(n: str) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Counts of all words of all documents; tasks add up first, only counts are shuffled."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                data, offsets = buffers(batch.column("text"))
                # All of a batch at once: the fewer the pieces, the fewer the rows of counts.
                for a, b in slices(offsets, BATCH_BYTES):
                    codes, hashed, _ = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if len(codes):
                        yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(np.bincount(codes))], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long")
    counts = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # A few hundred steps whatever the corpus.
    steps = collected(counts.groupBy(_step("n").alias("step")).agg(F.count("*").alias("size"), F.sum("n").alias("n")))
    steps = steps.sort_values("step", ascending=False)
    some = int(np.searchsorted(np.cumsum(steps["size"].to_numpy(int)), HEAD, "right"))
    least = int(steps["step"].iloc[some - 1]) if some else 1 << 30
    top = collected(counts.where(_step("n") >= least)).sort_values(["n", "word"], ascending=[False, True])

    power = round(np.log2(max(float(steps["n"].sum()), 1.0)) / 2)
    classes = min(max(1 << power, LEAST_CLASSES), MOST_CLASSES)
    tail, own = classes // TAIL_SHARE, classes - classes // TAIL_SHARE
    shared = collected(counts.groupBy(F.pmod("word", F.lit(tail)).alias("tail")).agg(F.sum("n").alias("n")))
    word, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(float)
    totals = np.zeros(classes)
    totals[: min(own, len(n))] = n[:own]
    totals[own + shared["tail"].to_numpy(int)] = shared["n"]
    # Words with a class of their own do not belong to the shared classes.
    np.subtract.at(totals, own + word[:own] % tail, n[:own])
    of = np.append(np.arange(min(own, len(word))), own + word[own:] % tail).astype(np.int64)
    parts = np.log(n) - np.log(np.maximum(totals[of], 1))
    order = np.argsort(word)
    lookup = Lookup(word[order], of[order], parts[order], np.log(np.maximum(totals, 1)))
    rare = counts.where((F.col("n") > 1) & (_step("n") < least)) if some < len(steps) else None
    return Vocabulary(lookup, totals, rare)


class Network:
    """Parameters as views of one flat array, so that averaging is one sum."""

    def __init__(self, flat: np.ndarray, classes: int):
        self.flat, self.classes = flat, classes
        self.groups, self.width = shape_of(classes)
        self.parts, at = [], 0
        for shape in self.shapes(classes):
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def shapes(classes: int) -> list[tuple[int, ...]]:
        groups, width = shape_of(classes)
        return [(classes + 1, DIM), (len(OFFSETS), DIM, HIDDEN), (HIDDEN,), (HIDDEN, groups), (groups,), (groups, HIDDEN, width), (groups, width)]

    @classmethod
    def size(cls, classes: int) -> int:
        return sum(int(np.prod(shape)) for shape in cls.shapes(classes))

    @classmethod
    def start(cls, totals: np.ndarray) -> Network:
        """Small random weights; without context it gives the frequencies of the classes."""
        rng = np.random.default_rng(SEED)
        net = cls(rng.normal(0, 0.1, cls.size(len(totals))).astype(np.float32), len(totals))
        counts = (np.maximum(totals, 0) + 1).reshape(net.groups, net.width)
        net.parts[1][:] *= 3
        net.parts[2][:] = 0
        net.parts[4][:] = np.log(counts.sum(axis=1) / counts.sum())
        net.parts[6][:] = np.log(counts / counts.sum(axis=1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        table, mix, bias = self.parts[:3]
        return np.tanh(_rows(table, context).reshape(len(context), -1) @ mix.reshape(-1, HIDDEN) + bias)

    def small(self) -> bool:
        """Whether no logit can be so large or so small that its exponential leaves single precision."""
        top, top_bias, low, low_bias = self.parts[3:]
        # The extremes bound the sums, and nearly always suffice.
        if max(_extreme(top), _extreme(low)) * HIDDEN + max(_extreme(top_bias), _extreme(low_bias)) < LARGEST_LOGIT / 2:
            return True
        outer = np.abs(top).sum(axis=0) + np.abs(top_bias)
        inner = np.abs(low).sum(axis=1) + np.abs(low_bias)
        return bool(max(outer.max(), inner.max()) < LARGEST_LOGIT)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target class in its context."""
        top, top_bias, low, low_bias = self.parts[3:]
        small = self.small()
        # Positions of one group lie side by side, so that its part is a view.
        order = _order(target // self.width, self.groups)
        group, member = target[order] // self.width, target[order] % self.width
        longer, found = np.ones((len(target), HIDDEN + 1), np.float32), np.zeros(len(target))
        context, tops, lows = _rows(context, order), _with_bias(top, top_bias), _with_bias(low, low_bias)
        for first in range(0, len(target), SOME):
            own = slice(first, first + SOME)
            longer[own, :HIDDEN] = self.hidden(context[own])
            found[own] = _log_parts(longer[own] @ tops, group[own], small)
        for g, first, last in _by_group(group, self.groups):
            found[first:last] += _log_parts(longer[first:last] @ lows[g], member[first:last], small)
        out = np.empty(len(target))
        out[order] = found
        return out

    def step(self, rates: Rates, context: np.ndarray, target: np.ndarray) -> None:
        """One step on these positions; only the rows and groups that they touch are changed."""
        table, mix, bias, top, top_bias, low, low_bias = self.parts
        small = self.small()
        order = _order(target // self.width, self.groups)
        context, group, member = _rows(context, order), target[order] // self.width, target[order] % self.width
        before = _rows(table, context).reshape(len(context), -1)
        hidden = np.tanh(before @ mix.reshape(-1, HIDDEN) + bias)
        scale = np.float32(1 / len(target))
        rows = np.arange(len(target))
        longer = np.concatenate([hidden, np.ones((len(hidden), 1), np.float32)], axis=1)
        back, tops = np.empty((len(target), HIDDEN), np.float32), _with_bias(top, top_bias)
        to_top = np.zeros_like(tops)
        # Each step of the work on some rows before the next rows, while they are in the cache. Errors are ``errors``
        # times ``part``; the products, which are smaller, are scaled instead.
        for first in range(0, len(target), SOME):
            own = slice(first, first + SOME)
            errors = longer[own] @ tops
            sums = _exponentials(errors, small)
            errors[rows[: len(errors)], group[own]] -= sums
            part = (scale / sums)[:, None]
            np.multiply(errors @ top.T, part, out=back[own])
            to_top += (longer[own] * part).T @ errors
        touched = _by_group(group, self.groups)
        at = slice(None) if len(touched) == self.groups else np.array([g for g, _, _ in touched], np.int64)
        lows = _with_bias(low[at], low_bias[at])
        to_parts, below = np.empty_like(lows), np.empty_like(back)
        ends = np.array([last for _, _, last in touched])
        for a, b in slices(np.append(0, ends), SOME):
            start, end = touched[a][1], touched[b - 1][2]
            errors = np.empty((end - start, self.width), np.float32)
            own = [(longer[first:last], errors[first - start : last - start]) for _, first, last in touched[a:b]]
            for weights, (values, logits) in zip(lows[a:b], own):
                np.matmul(values, weights, out=logits)
            sums = _exponentials(errors, small)
            errors[rows[: len(errors)], member[start:end]] -= sums
            part = (scale / sums)[:, None]
            scaled, under = longer[start:end] * part, below[start:end]
            for weights, to_part, (_, wrong), (_, first, last) in zip(lows[a:b, :HIDDEN].transpose(0, 2, 1), to_parts[a:b], own, touched[a:b]):
                np.matmul(wrong, weights, out=under[first - start : last - start])
                np.matmul(scaled[first - start : last - start].T, wrong, out=to_part)
            under *= part
        back += below
        rates.update(5, at, to_parts[:, :HIDDEN])
        rates.update(6, at, to_parts[:, HIDDEN])
        back *= 1 - hidden * hidden
        to_table = (back @ mix.reshape(-1, HIDDEN).T).reshape(-1, DIM)
        flat = context.ravel()
        order = _order(flat, self.classes)
        flat = flat[order]
        cuts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        rates.update(1, slice(None), (before.T @ back).reshape(mix.shape))
        rates.update(2, slice(None), back.sum(axis=0))
        rates.update(3, slice(None), to_top[:HIDDEN])
        rates.update(4, slice(None), to_top[HIDDEN])
        rates.update(0, flat[cuts], _sums(_rows(to_table, order), cuts))


class Rates:
    """Adaptive steps by the squares that each parameter has seen, so that untouched ones stay."""

    def __init__(self, net: Network, rate: float = RATE):
        self.parts, self.rate = net.parts, np.float32(rate)
        self.squares = Network(np.full(len(net.flat), 1e-10, np.float32), net.classes).parts

    def update(self, part: int, at: int | slice | np.ndarray, gradient: np.ndarray) -> None:
        squares, values = self.squares[part], self.parts[part]
        if isinstance(at, slice):
            # In pieces that stay in a core's cache, and in place.
            piece = max(SOME * BLOCK // max(gradient[:1].size, 1), 1)
            for first in range(0, len(gradient), piece):
                own = slice(first, first + piece)
                seen = gradient[own] * gradient[own]
                squares[own] += seen
                np.sqrt(squares[own], out=seen)
                np.divide(gradient[own], seen, out=seen)
                seen *= self.rate
                values[own] -= seen
            return
        seen = gradient * gradient
        seen += _rows(squares, at)
        squares[at] = seen
        np.sqrt(seen, out=seen)
        np.divide(gradient, seen, out=seen)
        seen *= self.rate
        values[at] = np.subtract(_rows(values, at), seen, out=seen)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` of places that are known to be in the table; several times as fast as with checks."""
    return np.take(table, at, axis=0, mode="clip")


def _sums(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` between cuts; two numbers are added at a time, as one complex number."""
    return np.add.reduceat(rows.view(np.complex64), cuts, axis=0).view(np.float32)


def _extreme(values: np.ndarray) -> float:
    return max(float(values.max()), -float(values.min()))


def _order(values: np.ndarray, most: int) -> np.ndarray:
    """Their stable order; short integers are sorted by their digits, which is faster."""
    return np.argsort(values.astype(np.uint16) if most < 1 << 16 else values, kind="stable")


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights for the hidden values and a 1 after them."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _exponentials(logits: np.ndarray, small: bool) -> np.ndarray:
    """Puts in the place of ``logits`` their exponentials, of large ones less the greatest of their row; sums of the rows."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    return np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)


def _log_parts(logits: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    """Logarithm of the softmax at each target; works in the place of ``logits``."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    return own.astype(float) - np.log(_exponentials(logits, True))


def _by_group(group: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """The groups that occur in ``group``, which is in order, and where each begins and ends."""
    cuts = np.searchsorted(group, np.arange(groups + 1)).tolist()
    return [(g, cuts[g], cuts[g + 1]) for g in range(groups) if cuts[g + 1] > cuts[g]]


def _spaced(classes: np.ndarray, by_text: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes with places of the class ``outside`` around each text, and where each word is."""
    margin = max(OFFSETS)
    place = np.arange(len(classes)) + margin * (np.repeat(np.arange(len(by_text) - 1), np.diff(by_text)) + 1)
    spaced = np.full(len(classes) + margin * (len(by_text) + 1), outside)
    spaced[place] = classes
    return spaced, place


def _contexts(spaced: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Classes around each place; beyond the ends of its text lies the class ``outside``."""
    return _rows(spaced, place[:, None] + np.array(OFFSETS))


def positions(by_text: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Positions that round ``number`` trains on: those in turn within each text, so that every
    position belongs to one round however the texts are dealt."""
    within = np.arange(by_text[-1]) - np.repeat(by_text[:-1], np.diff(by_text))
    return np.flatnonzero(within % rounds == number)


def train(docs: DataFrame, words_of: Vocabulary, rounds: int = ROUNDS, text_col: str = "text") -> Network:
    """Parameters averaged over the tasks, in ``rounds`` rounds over all documents."""
    net = Network.start(words_of.totals)
    source = docs.select(F.col(text_col).cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    lookup, classes, size = words_of.lookup, net.classes, len(net.flat)
    blocks = -(-size // BLOCK)
    for number in range(rounds):
        begin = net.flat.copy()

        def run(batches: Iterator[pa.RecordBatch], begin=begin, number=number) -> Iterator[pa.RecordBatch]:
            with task_memory():
                own, seen = Network(begin.copy(), classes), 0
                rates = Rates(own)
                for batch in batches:
                    data, offsets = buffers(batch.column("text"))
                    for a, b in slices(offsets):
                        codes, hashed, by_text = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                        if not len(codes):
                            continue
                        placed = lookup.of(hashed)[0][codes]
                        spaced, place = _spaced(placed, by_text, classes)
                        at = np.random.default_rng(number).permutation(positions(by_text, number, rounds))
                        for first in range(0, len(at), BATCH):
                            some = at[first : first + BATCH]
                            own.step(rates, _contexts(spaced, place[some]), placed[some])
                            seen += len(some)
                if seen:
                    padded = np.zeros(blocks * BLOCK)
                    padded[:size] = own.flat.astype(float) * seen
                    columns = [pa.array(np.arange(blocks)), pa.array(np.full(blocks, float(seen)))]
                    columns += [pa.array(c) for c in padded.reshape(blocks, BLOCK).T]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "seen", *[f"v{i}" for i in range(BLOCK)]])

        schema = f"block long, seen double, {', '.join(f'v{i} double' for i in range(BLOCK))}"
        summed = source.mapInArrow(run, schema).groupBy("block").agg(
            F.sum("seen").alias("seen"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(BLOCK)]
        )
        found = collected(summed).sort_values("block")
        if len(found):
            values = found[[f"v{i}" for i in range(BLOCK)]].to_numpy() / found[["seen"]].to_numpy()
            net = Network(values.ravel()[:size].astype(np.float32), classes)
    return net


def score(docs: DataFrame, words_of: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every whole text.

    ``log_prob`` sums the log-probability of every word given the words on both sides. A word that shares
    its class has the part of it that its count in the corpus gives; one that the corpus does not hold
    counts as occurring once. One scan of the texts; the counts of words outside the head are joined
    with these words alone, if any of them occurs twice. A null or empty text has no words, a sum of 0 and no
    mean. Repeated rows are scored each for itself; an empty table has no rows.
    """
    source = id_text(docs, id_col, text_col)
    lookup, join = words_of.lookup, words_of.rare is not None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        counts, sums, rare, sizes = [], [], [], []
        for a, b in slices(offsets, 1 << 20):
            codes, hashed, by_text = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = lookup.places(hashed)
            distinct, found = lookup.of(hashed, at)
            parts = lookup.part(at, distinct, found)
            classes = distinct[codes]
            spaced, place = _spaced(classes, by_text, net.classes)
            each = np.zeros(len(classes))
            for first in range(0, len(classes), 1 << 15):
                at = slice(first, first + (1 << 15))
                each[at] = net.log_probs(_contexts(spaced, place[at]), classes[at])
            each += parts[codes]
            counts.append(np.diff(by_text))
            sums.append(segment_sum(each, by_text))
            outside = ~found[codes] if join else np.zeros(len(codes), bool)
            rare.append(hashed[codes[outside]])
            sizes.append(segment_sum(outside.astype(np.int64), by_text))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rare).astype(np.int64)))
        columns = [batch.column("doc_id"), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(sums)), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "log_prob", "rare"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(source, run, f"doc_id {kind}, n_words long, log_prob double, rare array<long>")
    if join:
        # Numbers of rows are fixed by the written table.
        rows = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()), "scored-rows")
        asked = rows.select("row", F.explode("rare").alias("word"))
        added = asked.join(words_of.rare, "word").groupBy("row").agg(F.sum(F.round(F.log("n") * LOG_UNIT).cast("long")).alias("added"))
        scored = rows.drop("rare").join(added, "row", "left").withColumn(
            "log_prob", F.col("log_prob") + F.coalesce(F.col("added") / F.lit(LOG_UNIT), F.lit(0.0))
        )
    return scored.select("doc_id", "n_words", "log_prob", F.try_divide("log_prob", "n_words").alias("mean_log_prob"))
