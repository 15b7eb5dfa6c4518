"""What the driver does and holds for the pipeline: no more rounds than the links need, no second run of a
stage's work, no model's numbers as rows."""

from pyspark.sql import functions as F

from vecmill.llm import components, quality, stages, toxicity


def test_stars_need_no_round(spark, monkeypatch):
    written, real = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name, **options: written.append(name) or real(df, name, **options))
    frame = lambda links: spark.createDataFrame(links, "u long, v long")
    stars = [(1, 5), (7, 1), (1, 7), (9, 10), (3, 3), (None, 4)]
    found = {(r.node, r.component) for r in components.components(frame(stars)).collect()}
    assert found == {(1, 1), (5, 1), (7, 1), (9, 9), (10, 9)}
    assert len(written) == 1
    assert components.components(frame([])).count() == 0
    # A node with two smaller ones, and a chain.
    assert not components.settled(frame([(3, 1), (3, 2)]))
    assert not components.settled(frame([(2, 1), (3, 2)]))
    assert components.settled(frame([(2, 1), (3, 1), (9, 8)]))
    for links in ([(3, 1), (3, 2)], [(2, 1), (3, 2)]):
        assert {(r.node, r.component) for r in components.components(frame(links)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_dropped_ids_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    dropped = spark.range(0, 40, 2, 2).withColumnRenamed("id", "doc_id").mapInArrow(run, "doc_id long")
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    kept = [r.doc_id for r in stages.without_ids(docs, dropped).collect()]
    assert sorted(kept) == [*range(1, 40, 2), *range(40, 50)]
    assert made.value == 20


def test_models_come_as_arrays(spark, monkeypatch):
    kind, rows = type(spark.range(1)), []
    for name in ("toPandas", "collect"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, real=real: rows.append(len(out := real(self))) or out)
    texts = [f"word{i % 7} other{i % 11} more{i % 301} than that{i % 5}" for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels)
    toxicity.fit(docs, labels)
    # Counts of classes and of steps of counts, not the words, vectors, parameters and features.
    assert rows and max(rows) <= 64
