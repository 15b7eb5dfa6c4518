"""Toxicity learns, calibrates and sets its thresholds from every labelled row outside the held-out fold."""

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vecmill.llm import bottomk, columnar, labelled, quality, toxicity


def test_every_labelled_row_is_used_whole(spark):
    long = " ".join(f"x{i % 50}" for i in range(20_001))
    rows = [(i, f"w{i % 9} good" if i % 2 else f"w{i % 9} bad", "en") for i in range(8000)] + [(8000 + i, long, "de") for i in range(8)]
    docs = spark.createDataFrame([*rows, (9000, "none", "en"), (9001, None, "en"), (None, "none", "en")], "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 9000 and doc_id is not null").select("doc_id", F.expr("int(1 - doc_id % 2)").alias("toxic"))
    found = toxicity.learning_rows(docs, labels.unionByName(labels.limit(50))).toPandas()
    want = {i: t for i, t, _ in rows}
    learnt = [r.doc_id for r in labels.where(labelled.remainder("doc_id", toxicity.FOLDS) != toxicity.HELD).collect()]
    assert sorted(map(len, found["words"])) == sorted(len(want[i].split()) for i in learnt)
    assert len(found) > 2 * 2900 and 0.1 < found["calibrates"].mean() < 0.3
    table = spark.createDataFrame([(int(r.label), [int(w) for w in r.words]) for r in found.itertuples()], "label int, words array<int>")
    counts = {r.bucket: (r.n, r.ones) for r in toxicity.bucket_counts(table).collect()}
    n, ones = collections.Counter(), collections.Counter()
    for r in found.itertuples():
        n.update({int(w) for w in r.words})
        ones.update({int(w) for w in r.words} if r.label else ())
    assert counts == {b: (n[b], ones[b]) for b in n}
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("doc_id < 8000").toPandas()
    assert (scored["predicted"] == scored["toxic"]).mean() > 0.99


def test_sums_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(quality, "SUM_WORDS", 40)
    monkeypatch.setattr(quality, "CHUNK", 30)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in [0, 1, 2, 300, 0, 5, 23, 24, 25, 41, 80, 81, 3, 0]]
    codes, distinct, by_text = quality.spelled(*quality.buffers(pa.array(texts)))
    each = rng.integers(-9, 9, (len(distinct), 7)).astype(np.float32)
    sums = quality._text_sums(each, codes, by_text)
    assert np.array_equal(sums, [each[codes[a:b]].sum(axis=0) for a, b in zip(by_text, by_text[1:])])
    triples = quality._repeated_triples(codes, np.repeat(np.arange(len(texts)), np.diff(by_text)), len(texts))
    words = [re.findall(r"\S+", t) for t in texts]
    assert triples.tolist() == [max(len(w) - 2, 0) - len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) for w in words]


def test_packed_words_move_and_are_whole():
    rng = np.random.default_rng(5)
    texts = ["", None, "  ", "one", " ".join(f"w{k}" for k in rng.integers(0, 9000, 5000)), "x " * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["en"] * 6), pa.array(texts)], ["doc_id", "lang", "text"])
    found = toxicity.packed(batch)
    codes, bucket, by_text = toxicity.buckets(*toxicity.buffers(batch.column("text")))
    lists = toxicity.unpacked(found.column("words"), found.column("n").to_numpy())
    assert lists.to_pylist() == [bucket[codes[a:b]].tolist() for a, b in zip(by_text, by_text[1:])]
    assert found.column("n").to_pylist() == [0, 0, 0, 1, 5000, 9000]
    assert max(map(len, found.column("words").to_pylist())) < 3 * 5000 < len(texts[4])


def test_no_text_is_dealt_for_the_labels(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = toxicity.learning_rows(docs, labels)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan.index("Join")
    assert "text" not in plan[join : plan.index("MapInArrow", join)]
    assert sum(len(r.words) for r in rows.collect()) == 2 * rows.count() > 0


def test_one_worker_a_task_reads_learning_rows(spark):
    docs = spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    plan = toxicity.packed_rows(docs, docs.select("doc_id", F.lit(1).alias("toxic")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_sketches_free_what_a_task_has_kept(spark):
    class Caught:
        schema = spark.range(1).withColumnRenamed("id", "doc_id").schema
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    columnar._KEPT["old"] = 1
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"])], ["doc_id", "text"])
    assert [b.num_rows for b in bottomk.sketches(Caught, 64)(iter([batch]))] == [1]
    assert not columnar._KEPT
