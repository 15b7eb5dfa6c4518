"""Repeated passages against a plain search and the SQL counterpart."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vecmill.llm import substrings
from vecmill.llm.queries import ORACLES


def plain(rows):
    """Distinct rows in order of their ids; rows of one id do not see each other."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        for j in range(len(w := (text or "").split()) - 19):
            key = tuple(w[j : j + 20])
            first.setdefault(key, i)
    for i, text in order:
        w, seen, gone = (text or "").split(), set(), set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if first[key] != i or key in seen:
                gone |= set(range(j, j + 20))
            seen.add(key)
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


def rows_with_repeats(seed):
    rng = random.Random(seed)
    word = lambda k: f"w{rng.randrange(k)}é"
    passage, base = [word(9999) for _ in range(60)], [word(9999) for _ in range(200)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, " ".join(passage[:20])), (6, "\n".join(passage[:20])), (7, "w " * 50), (8, "w " * 19)]
    rows += [(10 + i, " ".join(base)) for i in range(6)]
    for i in range(40):
        rows.append((100 + i, " ".join(w if rng.random() > i / 400 else word(9999) for w in base)))
        rows.append((200 + i, " ".join([word(9999) for _ in range(rng.randint(0, 40))] + passage[: rng.randint(15, 60)] + [word(9999) for _ in range(rng.randint(0, 40))])))
        rows.append((300 + i, " ".join(word(2) for _ in range(80))))
    rows += [(400, " ".join(base + passage + base)), (401, " ".join(word(99999) for _ in range(40_000)))]
    rows += [(None, " ".join(base)), (None, " ".join(word(9999) for _ in range(30))), (150, " ".join(passage + base)), (150, " ".join(passage + base))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions,limit,hot", [(1, 32 << 20, 4096), (7, 2000, 3), (7, 0, 10**9)])
def test_repeats(spark, monkeypatch, partitions, limit, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = rows_with_repeats(partitions)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, own int").repartition(partitions)
    found = substrings.remove_repeats(docs, texts=True, bucket_bytes=limit)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_windows_under_one_hash(monkeypatch):
    monkeypatch.setattr(substrings, "_rows", lambda hashed, size: np.zeros(max(len(hashed) - size + 1, 0), np.uint64))
    codes = np.array([*range(25), *range(25), *range(5, 30)])
    at = np.array([0, 5, 25, 30, 50, 55])
    found = substrings.earlier(codes, at, np.zeros(6, np.int64), np.array([9, 9, 5, 5, 7, 7]))
    # Words 0..19 and 5..24 stand in the first two texts, 5..24 in the third too, 10..29 only there.
    assert found.tolist() == [True, True, False, False, True, False]


def test_minimisers_agree():
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(500)).encode()
    packed, keys, rows, starts, sizes = substrings.super_kmers(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = text.split()
    assert sizes.sum() == 481 and not rows.any() and starts.tolist() == np.cumsum([0, *sizes[:-1]]).tolist()
    by_window = {}
    for own, key, start, size in zip(packed, keys.tolist(), starts.tolist(), sizes.tolist()):
        assert own == b" ".join(words[start : start + size + 19])
        for i in range(start, start + size):
            assert by_window.setdefault(tuple(words[i : i + 20]), key) == key


def test_super_kmers_travel_pressed(monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_ROWS", 700)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(40_000)).encode()
    packed, keys, _, starts, _ = substrings.super_kmers(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    table = pa.table([keys, pa.array(packed, pa.binary()), starts, starts % 3 == 0, starts % 5], substrings.PACKED)
    pressed = list(substrings.press(table, 5))
    found = pa.Table.from_batches(part for batch in pressed for part in substrings.unpress(batch))
    by_start = lambda t: t.sort_by("least").combine_chunks()
    assert by_start(found).equals(by_start(table))
    # One partition a minimiser, several rows a partition, and far fewer bytes than the rows have.
    dealt = {}
    for batch in pressed:
        for row in range(batch.num_rows):
            for part in substrings.unpress(batch.slice(row, 1)):
                assert part.num_rows <= 700
                for key in part.column("minimiser").to_pylist():
                    assert dealt.setdefault(key, batch.column("partition")[row].as_py()) == batch.column("partition")[row].as_py()
    assert set(dealt.values()) == set(range(5))
    assert sum(len(x.as_py()) for batch in pressed for x in batch.column("pressed")) * 2 < sum(map(len, packed))
    assert not list(substrings.press(table.slice(0, 0), 5))


def test_nothing_to_read(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_counterpart(spark):
    rows = [r for r in rows_with_repeats(3) if r[0] not in (None, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    duck = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = duck.sql(ORACLES["op12_substring_dedup"])
    found = substrings.remove_repeats(docs).select(*want.columns).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall())
