import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from vecmill.functions import text as X
from vecmill.operators import search, tokenizing
from vecmill.session import cut_lineage

BOOKS = [
    ("1", "Infinite Jest", "David Foster Wallace"),
    ("2", "Ulysses", "James Joyce"),
    ("3", "Just Kids", "Patti Smith"),
]
TEXTS = [
    (0, "Der Hund, der Hund und die Katze."),
    (1, "L'été à la mer — l'été!"),
    (2, ""),
    (3, "  ...  "),
    (4, "one"),
    (5, None),
    (6, "der der der " * 50),
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string")


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def tokens_of(text):
    return re.findall(r"[^\W_]+|[^\w\s]|_", text or "")


def test_words_and_tokens(texts):
    for row in texts.select("text", X.words("text").alias("w"), X.tokens("text").alias("t")).collect():
        if row["text"] is not None:
            assert row["w"] == words_of(row["text"])
            assert row["t"] == tokens_of(row["text"])


def test_tokenize_truncates_and_pads(texts):
    out = {r["doc_id"]: r for r in tokenizing.tokenize(texts, max_length=6).collect()}
    assert out[4]["tokens"] == ["[CLS]", "one", "[SEP]", "[PAD]", "[PAD]", "[PAD]"]
    assert out[4]["attention_mask"] == [1, 1, 1, 0, 0, 0]
    assert out[0]["tokens"] == ["[CLS]", "Der", "Hund", ",", "der", "[SEP]"]
    assert out[0]["n_tokens"] == 9 and out[6]["n_tokens"] == 150
    assert out[2]["tokens"] == ["[CLS]", "[SEP]"] + ["[PAD]"] * 4
    whole = {r["doc_id"]: r for r in tokenizing.tokenize(texts, max_length=None).collect()}
    assert len(whole[6]["tokens"]) == 152 == len(whole[6]["attention_mask"])
    assert "Exchange" not in plan_of(tokenizing.tokenize(texts))


def expected_vocabulary():
    counts = Counter(t for _, text in TEXTS for t in tokens_of(text))
    ranked = sorted(counts.items(), key=lambda e: (-e[1], e[0].encode()))
    return {t: (n, i + 4) for i, (t, n) in enumerate(ranked)}


@pytest.mark.parametrize("head,size", [(500_000, 256), (2, 256), (500_000, 2)])
def test_vocabulary_and_ids(texts, monkeypatch, head, size):
    """A vocabulary beyond the head is joined, one within it is broadcast; the ids are the same."""
    monkeypatch.setattr(tokenizing, "HEAD_TERMS", head)
    monkeypatch.setattr(tokenizing, "HEAD_TERM_BYTES", size)
    vocabulary = tokenizing.build_vocabulary(texts)
    expected = expected_vocabulary()
    assert {r["token"]: (r["n"], r["token_id"]) for r in vocabulary.collect()} == expected
    ids = {r["doc_id"]: r for r in tokenizing.token_ids(texts, vocabulary, "doc_id", max_length=8).collect()}
    assert sorted(ids) == [0, 1, 2, 3, 4, 5, 6]
    for doc, text in TEXTS:
        body = [expected[t][1] for t in tokens_of(text)][:6]
        assert ids[doc]["input_ids"] == [2, *body, 3] + [0] * (6 - len(body))
        assert ids[doc]["attention_mask"] == [1] * (len(body) + 2) + [0] * (6 - len(body))
        assert ids[doc]["token_type_ids"] == [0] * 8


def test_unknown_terms(texts):
    vocabulary = tokenizing.build_vocabulary(texts.filter("doc_id = 4"))
    (row,) = tokenizing.token_ids(texts.filter("doc_id = 0"), vocabulary, "doc_id", max_length=4).collect()
    assert row["input_ids"] == [2, 1, 1, 3]


def test_texts_and_found_tokens_are_not_moved(spark, texts, monkeypatch):
    """Ids are written in the pass that reads the texts; only terms not found are exchanged, and
    only texts with such terms are joined. The plan is the same whatever the vocabulary."""
    vocabulary = cut_lineage(tokenizing.build_vocabulary(texts), "vocabulary")
    plans = []
    for head in (500_000, 2):
        monkeypatch.setattr(tokenizing, "HEAD_TERMS", head)
        plans.append(plan_of(tokenizing.token_ids(texts, vocabulary, "doc_id")))
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert all("text#" not in plan and "_tokens" not in plan for plan in plans)


def test_ids_of_texts_without_id(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a b c"), (1, None), (2, "c c a")], "doc_id int, text string")
    vocabulary = cut_lineage(tokenizing.build_vocabulary(docs), "vocabulary")
    for head in (500_000, 1):
        monkeypatch.setattr(tokenizing, "HEAD_TERMS", head)
        ids = tokenizing.token_ids(docs, vocabulary, "doc_id", max_length=5)
        assert {r["doc_id"]: r["input_ids"] for r in ids.collect()} == {
            None: [2, 5, 6, 4, 3], 1: [2, 3, 0, 0, 0], 2: [2, 4, 4, 5, 3]
        }


def bm25(docs, query, k):
    """By the formula, one document at a time."""
    words = {d: words_of(t) for d, t in docs}
    lengths = [len(w) for w in words.values() if w]
    n, mean = len(lengths), sum(lengths) / len(lengths)
    scores = []
    for d, w in words.items():
        score = 0.0
        for term in words_of(query):
            df = sum(term in other for other in words.values())
            tf = w.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if score:
            scores.append((-score, d))
    return [(d, -s) for s, d in sorted(scores)[:k]]


def test_match_on_titles(spark):
    books = spark.createDataFrame(BOOKS, "_id string, title string, author string")
    hits = search.match_topk(books, "_id", "title", {"q": "infinite"}).collect()
    assert [h["_id"] for h in hits] == ["1"]
    assert search.match_topk(books, "_id", "title", {"q": "nothing"}).isEmpty()
    with pytest.raises(ValueError, match="no query"):
        search.match_topk(books, "_id", "title", {"q": "..."})


@pytest.mark.parametrize("k", [1, 3, 10])
def test_match_equals_brute_force(spark, sf_dir, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    local = [tuple(r) for r in docs.collect()]
    queries = {"a": "the and Que der", "b": "eau eau los", "c": "zzzz"}
    got = {}
    for r in search.match_topk(docs.repartition(5), "doc_id", "text", queries, k).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["doc_id"], r["score"]))
    for name, query in queries.items():
        expected = bm25(local, query, k)
        assert [d for d, _ in got.get(name, [])] == [d for d, _ in expected]
        assert [s for _, s in got.get(name, [])] == pytest.approx([s for _, s in expected])


def test_match_on_copies_of_one_text(spark, texts):
    """A third of the documents are the same hit; the cut to k comes before the shuffle."""
    copies = spark.range(3000).select(
        F.col("id").cast("int").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "der Hund").otherwise("die Katze").alias("text"),
    )
    hits = search.match_topk(copies, "doc_id", "text", {"q": "hund"}, 5)
    assert [r["doc_id"] for r in hits.orderBy("rank").collect()] == [0, 3, 6, 9, 12]
    plan = plan_of(hits)
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]


def test_the_texts_are_read_once(spark, texts):
    hits = search.match_topk(texts, "doc_id", "text", {"q": "der"})
    assert "text" not in plan_of(hits)


def test_the_plan_does_not_grow_with_the_queries(spark, texts):
    few, many = ({f"q{i}": f"der hund {i}" for i in range(n)} for n in (5, 500))
    plans = [search.match_topk(texts, "doc_id", "text", q) for q in (few, many)]
    assert len({len(plan_of(p).splitlines()) for p in plans}) == 1
    best = {r["query"] for r in plans[1].filter("rank = 1").collect()}
    assert len(best) in (0, 500)


def test_query_terms_too_large_to_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    queries = {"a": "the and Que der", "b": "eau eau los"}
    expected = rows_of(search.match_topk(docs, "doc_id", "text", queries, 5))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert rows_of(search.match_topk(docs, "doc_id", "text", queries, 5)) == expected


def test_no_documents(texts):
    none = texts.limit(0)
    assert search.match_topk(none, "doc_id", "text", {"q": "der"}).isEmpty()
    vocabulary = tokenizing.build_vocabulary(none)
    assert vocabulary.isEmpty()
    assert tokenizing.token_ids(none, vocabulary, "doc_id").isEmpty()
    (row,) = tokenizing.token_ids(texts.filter("doc_id = 4"), vocabulary, "doc_id", max_length=4).collect()
    assert row["input_ids"] == [2, 1, 3, 0]


def test_sparse_query(spark):
    rows = [(1, {"a": 1.0, "b": 2.0}), (2, {"b": 4.0}), (3, {"c": 9.0}), (4, None)]
    docs = spark.createDataFrame(rows, "id int, weights map<string,float>")
    hits = search.sparse_topk(docs, "id", "weights", {"q": {"a": 3.0, "b": 0.5}, "r": {"c": 1.0}})
    assert rows_of(hits.select("query", "id", "score", "rank")) == [
        ("q", 1, 4.0, 1),
        ("q", 2, 2.0, 2),
        ("r", 3, 9.0, 1),
    ]


def test_reindex_in_batches_of_fifty(spark):
    import pyarrow as pa

    docs = spark.range(0, 120, 1, 1)
    out = search.reindex(
        docs, lambda t: t.append_column("n", pa.array([t.num_rows] * t.num_rows, pa.int64()))
    )
    assert rows_of(out.groupBy("n").count()) == [(20, 20), (50, 100)]
