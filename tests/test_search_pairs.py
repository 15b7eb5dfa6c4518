"""Scores of queries are cut to the best in each task, with the rows that a join by term gives."""

import pytest

from conftest import rows_of
from vecmill.operators import search


@pytest.fixture
def scored(monkeypatch):
    """What is given to ``top_hits``."""
    given, cut = [], search.top_hits
    monkeypatch.setattr(search, "top_hits", lambda scores, *rest: given.append(scores) or cut(scores, *rest))
    return given


def test_pairs_of_query_and_document_are_no_rows(spark, scored):
    docs = spark.range(0, 3000, 1, 4).selectExpr("id as doc_id", "if(id % 3 = 0, 'der Hund', 'der und die Katze') as text")
    queries = {f"q{i}": f"der hund {i}" for i in range(20)}
    assert search.match_topk(docs, "doc_id", "text", queries, 5).count() == 100
    (scores,) = scored
    assert scores.count() <= 5 * 20 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("k", [1, 4, 50])
def test_odd_rows_as_with_a_join(spark, monkeypatch, k):
    texts = ["a b c", "b b", None, "", "c d e a", "e", "a a a b", "z"]
    rows = [(None if i % 7 == 0 else i % 23, texts[i % 8]) for i in range(90)] + [(100 + i, "b c") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    named = docs.selectExpr("'d' || doc_id as doc_id", "text")
    queries = spark.createDataFrame([("x", "a b"), ("x", "b"), (None, "c e"), ("y", "zz"), ("w", "a b c d e z")], "query string, text string")
    weights = [(1, {"a": 1.0, "b": -2.0}), (2, {"b": None, "c": 3.0}), (3, {"a": float("nan")}), (3, {"a": 0.5}), (4, None), (None, {"c": 3.0}), (5, {"c": 3.0})]
    vectors = spark.createDataFrame(weights, "id int, weights map<string,double>")
    asked = spark.createDataFrame([("q", "a", 1.0), ("q", "a", 2.5), ("q", "c", 1.0), (None, "b", -1.0), ("n", "c", None), ("n", "a", 1.0)], "query string, term string, weight double")

    def found():
        monkeypatch.setattr(search, "PARTS", 3)
        parts = [rows_of(search.match_topk(t, "doc_id", "text", queries, k)) for t in (docs, named)]
        return repr([*parts, rows_of(search.sparse_topk(vectors, "id", "weights", asked, k))])

    small = found()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert small == found()
