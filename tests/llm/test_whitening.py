"""Spectrum slicing and whitening against a library's eigenvalues and plain sums."""

import numpy as np
import pytest

from vecmill.llm import whitening


def matrices():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 10, 64, 200):
        yield (lambda a: a @ a.T)(rng.normal(size=(size, 2 * size)))
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        # Close, equal, tiny and no eigenvalues.
        yield (q * np.linspace(1, 1 + 1e-9, size)) @ q.T
        yield (q * np.repeat([5.0, 1.0], [size // 2, size - size // 2])) @ q.T
        yield (q * 10.0 ** -np.linspace(0, 15, size)) @ q.T
        yield np.eye(size) * 7
        yield np.diag(np.arange(size, dtype=float))
        yield np.zeros((size, size))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_leading_eigenvalues(matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 32)
    want = np.linalg.eigvalsh(matrix)[::-1]
    norm = max(want[0], 1e-300)
    sure = int((want > 2 * whitening.LEAST_SHARE * max(np.trace(matrix), 1e-300)).sum())
    assert min(32, sure) <= len(values) <= 32 and (np.diff(values) <= 0).all()
    assert np.abs(values - want[: len(values)]).max(initial=0) <= 1e-12 * norm
    assert np.abs(matrix @ vectors - vectors * values).max(initial=0) <= 1e-11 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) <= 1e-9


def test_counts():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    shifts = np.linspace(-20, 20, 101)
    assert (whitening.counts_above(*whitening.tridiagonal(a), shifts) == (np.linalg.eigvalsh(a)[:, None] > shifts).sum(axis=0)).all()


def expect(rows):
    usable = [(i, v) for i, v in rows if v is not None and len(v) == 12 and None not in v and np.isfinite(v).all()]
    x = np.floor(64 * np.array([v for _, v in usable], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:32]
    values, vectors = values[order], vectors[:, order]
    return usable, n, ((n * x - s) ** 2).sum(axis=1), c @ vectors / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=12) @ mix]) for i in range(400)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12)]
    rows += [(904, [float("inf")] * 12), (905, [1.0] * 11), (906, [0.0] * 12)]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n string, component int").repartition(4)
    found = whitening.whiten(docs).toPandas()
    usable, n, deviation, whitened, explained = expect(rows)
    assert len(found) == 12 * n and set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9
    found["vec_id"] = found["vec_id"].fillna(-1)
    got = found.sort_values(["component", "vec_id"], kind="stable")
    order = np.argsort([-1 if i is None else i for i, _ in usable], kind="stable")
    for k in range(12):
        own = got[got["component"] == k + 1]
        assert own["vec_id"].tolist() == [-1 if usable[i][0] is None else usable[i][0] for i in order]
        assert own["deviation"].tolist() == deviation[order].tolist()
        want, have = whitened[order, k], own["whitened"].to_numpy()
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-8
        assert np.allclose(own["explained"], explained[k], rtol=1e-10)


def test_whitening_of_little(spark):
    frame = lambda rows, kind="array<double>": spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = whitening.whiten(frame([(1, [1, 0]), (2, [0, 0])], "array<int>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in sorted(rows)] == [(1, 1, 2, 64 * 64, 1.0, 1.0), (2, 1, 2, 64 * 64, 1.0, 1.0)]
    # Far beyond the range of the integers, and long vectors.
    assert {r.deviation for r in whitening.whiten(frame([(1, [1e300]), (2, [-1e300])])).collect()} == {None}
    long = np.random.default_rng(1).normal(size=(40, 600)).tolist()
    rows = whitening.whiten(frame([(i, v) for i, v in enumerate(long)])).toPandas()
    assert len(rows) == 40 * 32 and rows["identity_error"].max() < 1e-6
    whitened = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(whitened.T @ whitened / 40 - np.eye(32)).max() < 1e-6
