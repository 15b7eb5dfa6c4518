"""Bounded samples of labelled rows, and word hashes, for the two text classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def remainder(id_col: str, folds: int) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def sample_ids(labels: DataFrame, label: str, folds: int, held: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids of each class, chosen by hash, none of the held-out fold.

    Rows without an id or a label are left out; of several labels of one id the largest counts.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col, folds) != held))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .withColumn("rank", F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)))
    )
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = []
    for c in (0, 1):
        # A cut of the hash leaves little more than ``bound`` rows to be sorted, however many tasks there are.
        share = min(1.0, (bound + 6 * bound**0.5 + 6) / max(counts.get(c, 0), 1))
        own = known.where((F.col("label") == c) & (F.shiftrightunsigned("rank", 11) <= int(share * (1 << 53))))
        classes.append(own.orderBy("rank", "doc_id").limit(bound))
    return classes[0].unionByName(classes[1]).select("doc_id", "label")


def class_totals(labels: DataFrame, label: str, folds: int, held: int, id_col: str = "doc_id") -> dict[int, int]:
    """Rows of each class among the labels outside the held-out fold."""
    learnt = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col, folds) != held))
    return {r["c"]: r["n"] for r in learnt.groupBy(F.col(label).cast("int").alias("c")).agg(F.count("*").alias("n")).collect()}


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of the distinct byte strings, the same in every process."""
    count = len(distinct)
    if not count:
        return np.zeros(0, np.uint64)
    distinct = distinct.cast(pa.large_binary())
    bounds = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + count + 1]
    body = distinct.buffers()[2]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    lengths = np.diff(bounds)
    place = (np.arange(len(data)) - np.repeat(bounds[:-1], lengths)) & 4095
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, np.uint64(0x100000001B3))]), dtype=np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    mixed = (total[bounds[1:]] - total[bounds[:-1]] + lengths.astype(np.uint64)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def bare(distinct: pa.Array) -> pa.Array:
    """Words without the ASCII signs around them."""
    text = distinct.cast(pa.string())
    return pc.ascii_trim(text, characters="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").cast(pa.binary())


class Adam:
    """The usual adaptive steps for a list of arrays."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for w, m, v, g in zip(self.weights, self.mean, self.square, gradients):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * fix * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, slope_only: bool = False) -> tuple[float, float]:
    """Slope and intercept that make ``sigmoid(slope * logit + intercept)`` a probability: Newton
    steps on the weighted likelihood. ``slope_only`` fits a temperature alone."""
    slope, intercept = 1.0, 0.0
    if len(logits) < 2 or labels.min() == labels.max():
        return slope, intercept
    rows = np.stack([logits] if slope_only else [logits, np.ones_like(logits)])
    start = np.array([1.0] if slope_only else [1.0, 0.0])
    # The slope stays positive: more of the logit is never less likely.
    least, most = np.array([0.02, -np.inf])[: len(start)], np.array([20.0, np.inf])[: len(start)]

    def loss(at: np.ndarray) -> float:
        z = at @ rows
        return float(weights @ (np.logaddexp(0, z) - labels * z) + 5e-4 * ((at - start) ** 2).sum())

    at, value = start, loss(start)
    for _ in range(50):
        p = sigmoid(at @ rows)
        error, curve = weights * (p - labels), weights * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((rows * curve) @ rows.T + 1e-3 * np.eye(len(rows)), rows @ error + 1e-3 * (at - start))
        # Full steps run away where the classes are few or apart, so they are halved until the loss falls.
        for _ in range(30):
            tried = np.clip(at - step, least, most)
            found = loss(tried)
            if found < value:
                break
            step = step / 2
        else:
            break
        moved, at, value = np.abs(tried - at).max(), tried, found
        if moved < 1e-6:
            break
    return float(at[0]), 0.0 if slope_only else float(at[1])
