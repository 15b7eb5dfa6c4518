"""Periodic runs against a plain search and the SQL counterpart."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vecmill.llm import periodic
from vecmill.llm.queries import ORACLES


def plain_runs(words):
    """Every lag, every stretch; a stretch counts at its smallest lag."""
    n, seen, found = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and (i, j) not in seen:
                seen |= {(i, j + q - k) for k in range(q, n)}
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k = rng.choice([1, 2, 2, 3, 5, 50])
            own = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5 and own:
                unit = [rng.randrange(max(k, 3)) for _ in range(rng.randint(1, 9))] * rng.randint(2, 9)
                i = rng.randrange(len(own))
                own[i:i] = unit[: len(unit) - rng.randrange(len(unit))]
            texts.append(own)
        codes = np.array([x for own in texts for x in own], np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        assert periodic.find_runs(codes, bounds) == [plain_runs(own) for own in texts]


def test_runs_of_long_words_sequences():
    for words, run in ((np.arange(40_000) % 9_000, (0, 40_000, 9_000)), (np.zeros(40_000, np.int64), (0, 40_000, 1))):
        assert periodic.find_runs(words.astype(np.int64), np.array([0, 40_000])) == [[run]]
    # Thue-Morse words, which polynomial hashes modulo 2**64 confuse, hold no fourth power.
    bits = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], np.int64)
    assert periodic.find_runs(bits, np.array([0, len(bits)])) == [[]]


def test_splitting_leaves_frequent_words_only():
    codes = np.array([1, 2] * 5 + [9] + [1, 2, 3] + [4] * 6)
    starts, lengths = periodic.split_segments(codes, np.array([0, len(codes)]))
    assert sorted(zip(starts.tolist(), lengths.tolist())) == [(0, 10), (14, 6)]


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a b a"), (5, "x x x x x"), (6, "x x x x x x"), (6, "x x x x x x"), (6, "other"),
    (None, "a a a a a a a b"), (7, "Ab ab Ab ab " * 6 + "é é é é é é é"), (8, "w " * 30_000), (9, " ".join(f"w{i % 7_000}" for i in range(30_000))),
]


@pytest.mark.parametrize("partitions", [1, 5])
def test_periodic_runs(spark, partitions):
    rows = ROWS + [(100 + i, " ".join(random.Random(i).choices("ab", k=i))) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_runs string, mark int").repartition(partitions)
    found = periodic.periodic_runs(docs, texts=True).collect()
    want = []
    for i, text in rows:
        words = (text or "").split()
        mark = None if i is None else zlib.crc32(str(i).encode())
        if mark is not None and mark % 10 == 0 and words:
            n, g = len(words), mark // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        own = plain_runs(words) if len(words) < 1000 else periodic.find_runs(pa.array(words).dictionary_encode().indices.to_numpy(), np.array([0, len(words)]))[0]
        best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
        dropped = {j for s, n, p in own for j in range(s + p, s + n)}
        left = " ".join(w for j, w in enumerate(words) if j not in dropped)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(own), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(left), lines, left))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_nothing_to_read(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_counterpart(spark):
    docs = spark.createDataFrame([r for r in ROWS[:7] if r[0]] + [(9, ROWS[9][1])] + [(100 + i, " ".join(random.Random(i).choices("ab", k=i))) for i in range(80)], "doc_id long, text string").dropDuplicates()
    duck = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = duck.sql(ORACLES["op13_periodic_runs"])
    found = periodic.periodic_runs(docs).select(*want.columns).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall())
