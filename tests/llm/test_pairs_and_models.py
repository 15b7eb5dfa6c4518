"""Near duplicates against all pairs; classifiers and scores on held-out rows; the pipeline."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from vecmill.llm import bottomk, components, ego, labelled, lm, quality, toxicity


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = joined({x for p in links for x in p}, links)
    assert found == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 9999)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "three"), (6, " \n ")]
    rows += [(10 + i, " ".join(base)) for i in range(5)]
    # Near copies around the limit, and short documents of which a shared passage is a half or more.
    for i in range(60):
        copy = [w if rng.random() > i / 1500 else word() for w in base]
        rows.append((100 + i, " ".join(copy)))
        rows.append((300 + i, " ".join([word() for _ in range(rng.randint(5, 60))] + passage)))
    rows.append((100, " ".join(base)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    sets = {i: shingles(t) for i, t in reversed(rows)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = joined(sets, links)
    once = docs.where("not (doc_id = 100 and length(text) = 0)").dropDuplicates(["doc_id", "text"])
    found = bottomk.near_duplicates(once).collect()
    assert len(found) == once.count()
    by_id = {r.doc_id: r for r in found if r.doc_id != 100}
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id.items()} == {i: (len(sets[i]), want[i]) for i in by_id}
    assert all(r.kept == (r.component_id == r.doc_id) for r in found)


def test_near_duplicates_of_nothing(spark):
    assert bottomk.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    seeds = rng.normal(size=(6, 24))
    rows = [(i, (seeds[i % 6] + rng.normal(0, 0.2, 24) * (i % 4)).tolist(), i % 2) for i in range(240)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [1.0, None], 1), (1004, [float("nan")] * 24, 1)]
    rows += [(1005, seeds[0].tolist(), None), (1006, [2 * x for x in rows[0][1]], 0), (1007, seeds[0].tolist()[:5], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(e), c) for i, e, c in rows if e and c is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [
        (a[0], b[0]) for a in good for b in good
        if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93 * np.linalg.norm(a[1]) * np.linalg.norm(b[1])
    ]
    count = collections.Counter(x for p in links for x in p)
    want = joined([r[0] for r in rows], links)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego.link(docs).collect()}
    assert len(links) > 100 and found == {i: (count[i], want[i], want[i] == i) for i in want}


def test_embedding_links_of_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, near(near(b)), 0), (1, c, 1), (5, near(c), 1), (6, near(c), 0), (7, c, 1)]
    for kind in ("double", "float"):
        found = sorted(tuple(r) for r in ego.link(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect())
        assert found == [
            (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False),
            (5, 2, 1, False), (6, 0, 6, True), (7, 2, 1, False),
        ]


@pytest.fixture(scope="module")
def data(spark):
    folder = SF.replace("0.001", "0.1")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.95)])
def test_classifiers_on_held_out_rows(spark, data, module, label, least):
    docs, labels = data
    model = module.fit(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows[label]).mean() > least
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect())
    assert module.score(odd.limit(0), module.fit(odd.limit(0), labels)).count() == 0


def test_quality_word_contexts(spark, monkeypatch):
    monkeypatch.setattr(quality, "WORDS", 60)
    monkeypatch.setattr(quality, "CHUNK", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(20)
    docs = docs.unionByName(docs.selectExpr(*[f"null as {c}" for c in docs.columns]))
    vectors = quality.word_vectors(docs)
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()) for r in docs.collect()]
    counts = collections.Counter(w for t in texts for w in t)
    hashed = lambda w: labelled.hashes(pa.array(w, pa.binary()))
    names = sorted(counts)
    number = dict(zip(names, range(len(names))))
    rows, weights = vectors.words.of(hashed(names))
    index = quality.index_vectors(hashed(names))
    assert 0 < len(vectors.words.known) <= 60
    least = min(counts[w] for w, r in zip(names, rows) if r < len(vectors.words.known))
    assert all(r < len(vectors.words.known) for w, r in zip(names, rows) if counts[w] >= least)
    want = np.zeros_like(vectors.table, float)
    for t in texts:
        for i, w in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    want[rows[number[w]]] += weights[number[t[j]]] * index[number[t[j]]]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(vectors.table, want / np.where(length > 0, length, 1), atol=1e-6)
    assert np.abs(want[: len(vectors.words.known)]).sum() > 0


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_change_nothing(spark, module, label):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = labelled.remainder("doc_id", module.FOLDS) == module.HELD
    changed = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)).cast("int"))
    scores = [{r.doc_id: r.score for r in module.score(docs, module.fit(docs, own)).collect()} for own in (labels, changed)]
    assert scores[0] == scores[1]


def test_language_model_beats_frequencies(spark, data):
    docs = data[0]
    words = lm.vocabulary(docs)
    total = lambda net: lm.score(docs, words, net).groupBy().sum("log_prob").first()[0]
    plain = lm.Network.start(words.totals)
    plain.parts[1][:] = 0
    assert total(lm.train(docs, words)) > 0.97 * total(plain)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_words, r.log_prob, r.mean_log_prob) for r in lm.score(odd, words, plain).collect()] == [(0, 0.0, None)] * 2


def test_language_model_trains_on_every_position(spark):
    bounds = np.array([0, 0, 1, 3, 20, 20, 57])
    assert sorted(np.concatenate([lm.positions(bounds, n, 3) for n in range(3)])) == list(range(57))
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    words = lm.vocabulary(docs)
    begin, end = lm.Network.start(words.totals).parts[0], lm.train(docs, words).parts[0]
    # The words around a trained position move; of a document of seven words all must.
    assert (begin[:7] != end[:7]).any(axis=1).all()


def test_language_model_counts_of_rare_words(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = lm.vocabulary(docs)
    net = lm.Network.start(full.totals)
    want = {r.doc_id: r.log_prob for r in lm.score(docs, full, net).collect()}
    assert full.rare is None
    counts = collections.Counter(w for r in docs.collect() for w in re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)))
    assert full.totals.sum() == sum(counts.values()) and len(full.lookup.head) == len(counts)
    # Parts of a class by own counts are one whole, class by class.
    sums = np.bincount(full.lookup.classes, np.exp(full.lookup.parts), len(full.totals))
    assert np.allclose(sums[full.totals > 0], 1)
    # With a small head, classes of their own are fewer; what is joined gives every word its own count.
    monkeypatch.setattr(lm, "HEAD", 3000)
    small = lm.vocabulary(docs)
    assert 0 < len(small.lookup.head) <= 3000 and small.rare is not None
    assert {r.doc_id: r.log_prob for r in lm.score(docs, small, net).collect()} == pytest.approx(want, rel=1e-9)


def test_language_model_classes_grow():
    sizes = [lm.Network.size(1 << k) for k in range(11, 17)]
    assert all(1.9 < b / a < 2.1 for a, b in zip(sizes, sizes[1:]))
    assert all(g * w == 1 << k for k in range(11, 17) for g, w in [lm.shape_of(1 << k)])


def test_language_model_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, 2.0, "x"), (1, "", 1.0, "y"), (2, "a " * 70000, 0.0, None), (2, "a " * 70000, 0.0, None)], "doc_id long, text string, log_prob double, word string")
    words = lm.vocabulary(odd)
    rows = sorted((r.doc_id, r.n_words, r.log_prob) for r in lm.score(odd, words, lm.train(odd, words)).collect())
    assert rows[:2] == [(1, 0, 0.0)] * 2 and rows[2] == rows[3] and rows[2][1] == 70000 and rows[2][2] <= 0
    none = odd.limit(0)
    words = lm.vocabulary(none)
    assert lm.score(none, words, lm.train(none, words)).collect() == []


def test_pipeline(spark):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.schema == docs.schema, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} and 0 < len(kept) < 200


def test_calibration_descends():
    # Two classes that are apart, one of them a single row: full Newton steps run away here.
    logits, labels = np.array([-1.9, -2.0, -2.1, -2.2, -2.05, -1.95, -2.15, -1.4]), np.array([0.0] * 7 + [1.0])
    slope, intercept = labelled.platt(logits, labels, np.ones(8))
    scores = labelled.sigmoid(slope * logits + intercept)
    assert slope > 0 and scores[:7].max() < scores[7] and scores.mean() == pytest.approx(1 / 8, abs=0.05)
    # Halves that overlap: the probabilities meet the shares.
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 20000)
    labels = (rng.random(20000) < labelled.sigmoid(0.5 * logits - 1)).astype(float)
    assert labelled.platt(logits, labels, np.ones(20000)) == pytest.approx((0.5, -1), abs=0.06)
