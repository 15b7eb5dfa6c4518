"""Whitening of embeddings by spectrum slicing (operator 11).

Sums and centred second moments are added up in the tasks, so only matrices of the vectors' length
are shuffled, whatever the number of rows. The leading eigenvalues of the covariance are found one by
one: the inertia of ``LDLᵀ`` factors of the shifted matrix counts the eigenvalues above a shift, and
halving intervals by these counts goes on until each holds one wanted eigenvalue. Rayleigh quotient
iteration then converges cubically to it, and is held to its interval. Counts just above and below
every result certify that the numbering misses none. The factors are those of a tridiagonal matrix
with the same inertia (Sylvester's law), which all intervals share; the iteration is on the matrix
itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.llm.columnar import bound_batches

COMPONENTS = 32
# The integers of a component.
SCALE, SHIFT = 64, 1_000_000
# Scaled components beyond this are cut to it, so that sums of a task fit in a long.
LIMIT = 1 << 40
# The least share of the trace that counts as an eigenvalue above zero.
LEAST_SHARE = 1e-11
EPS = np.finfo(float).eps


# --- eigenvalues -------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the same eigenvalues."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = 2 * (p - (x @ p) * x)
        rest -= np.outer(x, w) + np.outer(w, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def counts_above(diagonal: np.ndarray, squares: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: the positive pivots of the shifted matrix."""
    tiny = EPS * (np.abs(diagonal).max() + np.sqrt(squares.max(initial=0)) + 1e-300) * 1e-3
    pivot = diagonal[0] - shifts
    total = (pivot > 0).astype(int)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - squares[i - 1] / pivot
        total += pivot > 0
    return total


def _iterate(matrix: np.ndarray, low: float, high: float, found: np.ndarray, norm: float, seed: int) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration held to ``low .. high``, orthogonal to the vectors in ``found``:
    quotient, vector and residual."""
    size = len(matrix)
    project = lambda v: v - found @ (found.T @ v)
    vector = project(np.random.default_rng(seed).normal(size=size))
    vector /= np.linalg.norm(vector)
    shift, best = (low + high) / 2, (0.0, vector, np.inf)
    for step in range(40):
        try:
            solved = np.linalg.solve(matrix - shift * np.eye(size), vector)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(matrix - (shift + 4 * EPS * norm) * np.eye(size), vector)
        if not np.isfinite(solved).all():
            break
        vector = project(project(solved / np.abs(solved).max()))
        vector /= np.linalg.norm(vector)
        quotient = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - quotient * vector))
        if residual < best[2]:
            best = (quotient, vector, residual)
        elif step > 3:
            break
        # Two steps from the middle first; later the quotient, as long as it stays inside.
        shift = quotient if step >= 1 and low <= quotient <= high else (low + high) / 2
    return best


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as
    columns; those that do not exceed ``LEAST_SHARE`` of the trace are left out."""
    size, trace = len(matrix), float(np.trace(matrix))
    if not size or not trace > 0:
        return np.zeros(0), np.zeros((size, 0))
    diagonal, squares = tridiagonal(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    least = LEAST_SHARE * trace
    wanted = min(most, int(counts_above(diagonal, squares, np.array([least]))[0]))
    number = np.arange(1, wanted + 1)
    low, high = np.full(wanted, least), np.full(wanted, norm * (1 + 8 * EPS))
    above_low, above_high = np.full(wanted, counts_above(diagonal, squares, low[:1])[0] if wanted else 0), np.zeros(wanted, int)
    width = 16 * EPS * norm * np.sqrt(size)
    narrow = lambda: high - low <= width

    def halve(own: np.ndarray) -> None:
        middle = (low[own] + high[own]) / 2
        above = counts_above(diagonal, squares, middle)
        up = above >= number[own]
        low[own[up]], above_low[own[up]] = middle[up], above[up]
        high[own[~up]], above_high[own[~up]] = middle[~up], above[~up]

    while len(open_ := np.flatnonzero((above_low - above_high > 1) & ~narrow())):
        halve(open_)
    values, vectors = np.zeros(wanted), np.zeros((size, wanted))
    for k in range(wanted):
        while True:
            value, vector, residual = _iterate(matrix, low[k], high[k], vectors[:, :k], norm, k)
            inside = low[k] - width <= value - residual and value + residual <= high[k] + width
            if (inside and residual <= 64 * width) or narrow()[k]:
                break
            halve(np.array([k]))
        values[k], vectors[:, k] = value, vector
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    slack = 64 * width
    if wanted and ((counts_above(diagonal, squares, values + slack) >= number) | (counts_above(diagonal, squares, values - slack) < number)).any():
        raise ArithmeticError("the counts do not certify the eigenvalues")
    # Either sign is right; one is chosen so that it does not depend on the way there.
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values, vectors


# --- rows --------------------------------------------------------------------------------------


def integers(column: pa.Array, size: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The usable rows of a list column by length, or of one length: places and integer vectors."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    # Null rows may not own any values, so lengths follow the values that flatten() keeps.
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, lengths, 0)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in [size] if size else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        x = values[starts[rows][:, None] + np.arange(n)] if len(rows) else np.zeros((0, n))
        fine = np.isfinite(x).all(axis=1)
        scaled = np.clip(np.floor(SCALE * x[fine]), -LIMIT, LIMIT)
        out[n] = rows[fine], scaled.astype(np.int64) + SHIFT
    return out


@dataclass
class Sums:
    """Of all usable vectors of the commonest length: their number, sums, and extremes."""

    n: int
    size: int
    sums: list[int]
    low: list[int]
    high: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean, from whole numbers first."""
        whole = np.array([s // self.n for s in self.sums])
        part = np.array([s % self.n for s in self.sums]) / self.n
        return (x - whole) - part

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over the dimensions of ``(n * x - sum) ** 2``; null where a long cannot hold it."""
        reach = [max(self.n * h - s, s - self.n * a) for s, a, h in zip(self.sums, self.low, self.high)]
        size = max(abs(v) for v in (*self.low, *self.high)) * self.n + max(abs(s) for s in self.sums)
        if size < 1 << 62 and sum(r * r for r in reach) < 1 << 63:
            off = self.n * x - np.array(self.sums)
            return pa.array((off * off).sum(axis=1))
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def _source(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    element = vectors.schema[vector_col].dataType.elementType
    column = F.col(vector_col)
    if not isinstance(element, (T.FloatType, T.DoubleType)):
        column = column.cast("array<double>")
    return vectors.select(F.col(id_col).alias("vec_id"), column.alias("embedding"))


def sums(source: DataFrame) -> Sums | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for size, (_, x) in integers(batch.column("embedding")).items() if batch.num_rows else ():
                if len(x):
                    new = [len(x), x.sum(axis=0), x.min(axis=0), x.max(axis=0)]
                    old = held.get(size)
                    held[size] = new if old is None else [old[0] + new[0], old[1] + new[1], np.minimum(old[2], new[2]), np.maximum(old[3], new[3])]
        for size, (n, total, low, high) in held.items():
            columns = [np.full(size, size), np.arange(size), np.full(size, n), total, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["size", "i", "n", "total", "low", "high"])

    parts = source.select("embedding").mapInArrow(run, "size long, i long, n long, total long, low long, high long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), wide("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(found.collect(), key=lambda r: (-r.n, -r.size, r.i))
    if not rows:
        return None
    rows = [r for r in rows if r.size == rows[0].size]
    return Sums(rows[0].n, rows[0].size, [int(r.total) for r in rows], [r.low for r in rows], [r.high for r in rows])


def second_moments(source: DataFrame, stats: Sums, transform: np.ndarray) -> np.ndarray:
    """The covariance of the centred vectors times ``transform``, with divisor n: products of rows that
    are centred already are added up in the tasks, and the tasks' matrices by Spark."""
    size = transform.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                moved = stats.centred(integers(batch.column("embedding"), stats.size)[stats.size][1]) @ transform
                total += moved.T @ moved
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), size).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), rows], ["i", "row"])

    parts = source.select("embedding").mapInArrow(run, "i long, row array<double>")
    found = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(size)]).collect()
    out = np.zeros((size, size))
    for row in found:
        out[row.i] = row[1:]
    return (out + out.T) / (2 * stats.n)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each usable
    vector and component.

    Vectors that are null or empty or hold a null or a component that is not finite are left out, and
    so are those whose length is not the commonest one (of equally common ones the greatest). Repeated
    rows and ids count as rows, null ids stay. There are ``components`` components, or as many as have
    an eigenvalue above zero: none if all vectors are equal, and then no rows, as for an empty table.
    Components beyond 1.7e10 are cut to that; a ``deviation`` that a long cannot hold is null.
    """
    bound_batches(vectors.sparkSession)
    source = _source(vectors, id_col, vector_col)
    kind = source.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [part.split()[0] for part in schema.split(", ")]
    stats = sums(source)
    if stats is None:
        return source.where(F.lit(False)).mapInArrow(lambda batches: iter(()), schema)
    covariance = second_moments(source, stats, np.eye(stats.size))
    values, directions = leading(covariance, components)
    scaled = directions / np.sqrt(values)
    count = len(values)
    error = float(np.abs(second_moments(source, stats, scaled) - np.eye(count)).max()) if count else 0.0
    explained = values / np.trace(covariance) if count else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            places, x = integers(batch.column("embedding"), stats.size)[stats.size]
            own = pa.array(np.repeat(np.arange(len(x)), count))
            columns = [
                batch.column("vec_id").take(pa.array(places)).take(own), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(own), stats.n)), stats.deviations(x).take(own), pa.array((stats.centred(x) @ scaled).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(own), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)
