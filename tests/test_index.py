"""Search from a stored index gives the hits of a search over the texts."""

import random

import pytest

from conftest import rows_of
from vecmill.operators import index, search
from vecmill.session import cut_lineage


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    weights = [1.0 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.choice((1, 5, 30, 200))))) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "..."), (2003, "w0 " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in {"BLOCK": 4, "SEGMENT": 500, "SEED_POSTINGS": 20, "SEED_DOCS": 3}.items():
        monkeypatch.setattr(index, name, value)


def queries_of(spark, texts):
    asked = {f"d{r['doc_id']}": r["text"] for r in texts.filter("doc_id % 50 = 7 and doc_id < 600").collect()}
    return {**asked, "rare": "w299 w298", "common": "w0 w1", "repeated": "w5 w5 w5 w40", "one": "w3", "unknown": "nothing"}


@pytest.mark.parametrize("k", [1, 10])
def test_same_hits_as_over_the_texts(spark, texts, small_parts, tmp_path, k):
    path, queries = str(tmp_path / "index"), queries_of(spark, texts)
    index.build_index(texts, "doc_id", "text", path)
    expected = rows_of(search.match_topk(texts, "doc_id", "text", queries, k))
    assert rows_of(index.index_topk(spark, path, queries, k, "doc_id")) == expected


def test_same_hits_when_nothing_is_broadcast(spark, texts, small_parts, tmp_path, monkeypatch):
    path, queries = str(tmp_path / "index"), queries_of(spark, texts)
    index.build_index(texts, "doc_id", "text", path)
    expected = rows_of(search.match_topk(texts, "doc_id", "text", queries, 5))
    monkeypatch.setattr(index, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(index, "NAMED_TERMS", 0)
    assert rows_of(index.index_topk(spark, path, queries, 5, "doc_id")) == expected


def test_blocks_are_bounded_and_hold_every_posting(spark, texts, small_parts, tmp_path):
    path = str(tmp_path / "index")
    index.build_index(texts, "doc_id", "text", path)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.filter(f"size(ids) > {index.BLOCK} or bound < array_max(impacts) or impacts[0] < impacts[size(impacts) - 1]").isEmpty()
    forward = spark.read.parquet(f"{path}/forward")
    held = blocks.selectExpr("term", "explode(ids) as id")
    assert rows_of(held) == rows_of(forward.selectExpr("id", "inline(terms)").select("term", "id"))
    (corpus,) = spark.read.parquet(f"{path}/corpus").collect()
    assert corpus["docs"] == 641 and blocks.select("draw").distinct().count() > 5


def test_blocks_that_cannot_matter_are_skipped(spark, texts, small_parts, tmp_path, monkeypatch):
    path, kept = str(tmp_path / "index"), {}

    def watched(df, name):
        kept[name] = cut_lineage(df, name)
        return kept[name]

    index.build_index(texts, "doc_id", "text", path)
    monkeypatch.setattr(index, "cut_lineage", watched)
    assert index.index_topk(spark, path, {"q": "w299 w298 w280 w270 w0"}, 1).count() == 1
    total, read = kept["query-depths"].selectExpr("sum(n)", "sum(if(_read, n, 0))").first()
    assert read < total / 4


def test_empty_tables(spark, texts, tmp_path):
    none, path = texts.limit(0), str(tmp_path / "index")
    index.build_index(none, "doc_id", "text", path)
    assert index.index_topk(spark, path, {"q": "w0"}).isEmpty()
    with pytest.raises(ValueError, match="no query holds a word"):
        index.index_topk(spark, path, {"q": "..."})
