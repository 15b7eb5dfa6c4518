"""The fast forms in operator 10 against plain ones."""

import numpy as np
import pytest

from vecmill.llm import columnar, lm


def test_bytes_are_told_apart_as_by_the_tables():
    every = np.arange(256, dtype=np.uint8)
    assert np.array_equal(columnar.lowered(every), columnar.LOWER_ASCII)
    for text in (b"", b" ", b"a", b" a\t\tb\x0b", b"ab\x08 \x0e c"):
        data = np.frombuffer(text, np.uint8)
        for cut in range(len(text) + 1):
            body, bounds, by_text = columnar.words(data, np.array([0, cut, cut, len(text)]))
            parts = [text[:cut].split(), [], text[cut:].split()]
            assert body.tobytes() == b"".join(w for p in parts for w in p)
            assert np.diff(bounds).tolist() == [len(w) for p in parts for w in p]
            assert np.diff(by_text).tolist() == [len(p) for p in parts]


def test_places_of_words():
    rng = np.random.default_rng(3)
    head = np.unique(rng.integers(0, 1 << 62, 500))
    lookup = lm.Lookup(head, np.arange(len(head)), rng.normal(size=len(head)), rng.normal(size=2048))
    asked = np.concatenate([rng.permutation(head)[:200], rng.integers(0, 1 << 62, 200), head[-1:] + 1, head[:1] - 1, head[:3], head[:3]])
    at = lookup.places(asked)
    classes, found = lookup.of(asked, at)
    assert found.tolist() == [x in set(head.tolist()) for x in asked.tolist()]
    assert np.array_equal(head[at[found]], asked[found]) and np.array_equal(classes[found], at[found])
    assert np.array_equal(lookup.part(at, classes, found)[found], lookup.parts[at[found]])
    assert len(lookup.places(asked[:0])) == 0


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("rows", [1, 700, 4096])
def test_step_is_that_of_the_plain_gradient(large, rows):
    classes, rng = 2048, np.random.default_rng(rows)
    net = lm.Network.start(np.maximum(1e5 / np.arange(1, classes + 1), 1))
    if large:
        net.parts[4][:] += 400
        net.parts[6][3] -= 300
    assert net.small() != large
    data = np.minimum(rng.zipf(1.3, (rows, 5)), classes) - 1
    context, target = data[:, :4], data[:, 4]
    table, mix, bias, top, top_bias, low, low_bias = (p.astype(float) for p in net.parts)
    before = table[context].reshape(rows, -1)
    hidden = np.tanh(before @ mix.reshape(-1, lm.HIDDEN) + bias)
    group, member = target // net.width, target % net.width

    def errors(logits, at):
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        found = np.log(p[np.arange(rows), at])
        p[np.arange(rows), at] -= 1
        return p / rows, found

    outer, of_group = errors(hidden @ top + top_bias, group)
    inner, of_member = errors(np.einsum("nh,nhw->nw", hidden, low[group]) + low_bias[group], member)
    np.testing.assert_allclose(net.log_probs(context, target), of_group + of_member, atol=2e-3 if large else 1e-4)
    back = (outer @ top.T + np.einsum("nw,nhw->nh", inner, low[group])) * (1 - hidden**2)
    want = [np.zeros(s) for s in lm.Network.shapes(classes)]
    np.add.at(want[0], context.ravel(), (back @ mix.reshape(-1, lm.HIDDEN).T).reshape(-1, lm.DIM))
    want[1], want[2] = (before.T @ back).reshape(mix.shape), back.sum(axis=0)
    want[3], want[4] = hidden.T @ outer, outer.sum(axis=0)
    np.add.at(want[5], group, hidden[:, :, None] * inner[:, None, :])
    np.add.at(want[6], group, inner)
    rates, seen = lm.Rates(net), {}
    rates.update = lambda part, at, gradient: seen.__setitem__(part, (at, gradient.copy()))
    net.step(rates, context, target)
    for part, whole in enumerate(want):
        found = np.zeros(whole.shape)
        found[seen[part][0]] = seen[part][1]
        np.testing.assert_allclose(found, whole, atol=2e-5 * max(np.abs(whole).max(), 1e-3) + (2e-6 if large else 1e-7))
    # What updates write, in pieces or by rows.
    plain, gradient = lm.Rates(net), rng.normal(size=net.parts[5].shape).astype(np.float32)
    start, squares = net.parts[5].copy(), plain.squares[5] + gradient * gradient
    plain.update(5, slice(None), gradient)
    assert np.array_equal(net.parts[5], start - gradient / np.sqrt(squares) * plain.rate)
    at = np.array([2, 5])
    start, squares = net.parts[6].copy(), plain.squares[6][at] + 4
    plain.update(6, at, np.full((2, net.width), 2, np.float32))
    start[at] -= 2 / np.sqrt(squares) * plain.rate
    assert np.array_equal(net.parts[6], start)
