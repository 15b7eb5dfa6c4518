"""What a task holds to build an index does not grow with its batches."""

import collections
import random

import pyarrow as pa

from vecmill.operators import batches, index


def test_batches_are_counted_in_bounded_pieces(monkeypatch):
    draw = random.Random(4)
    docs = [None if i % 40 == 3 else [draw.choice("abcdefgh") for _ in range(draw.choice((0, 1, 9, 30, 120)))] for i in range(300)]
    table = pa.table({"id": range(300), "_words": pa.array(docs, pa.list_(pa.string()))})
    pieces, whole = [], index._counted_lists
    monkeypatch.setattr(index, "COUNTED_WORDS", 50)
    monkeypatch.setattr(index, "_counted_lists", lambda lists: pieces.append(lists) or whole(lists))
    found = index._counted(table)
    assert all(len(p) == 1 or len(p.flatten()) <= 50 for p in pieces) and len(pieces) > 50
    want = [sorted(collections.Counter(d or []).items()) for d in docs]
    assert [[(e["term"], e["tf"]) for e in row] for row in found["terms"].to_pylist()] == want
    assert index._counted(table.slice(0, 0)).num_rows == 0


def test_a_segment_gives_its_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(batches.pa, "default_memory_pool", lambda: calls.append(1) or pa.system_memory_pool())
    index.release_memory()
    assert calls
