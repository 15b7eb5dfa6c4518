"""Requests in parts, checked responses, and comparison of tables by digests."""

import pytest
from pyspark.sql import functions as F

from conftest import SF, plan_of, rows_of
from vecmill.functions import messages as M
from vecmill.operators.parity import count_differences, differing_buckets
from vecmill.operators.ranking import running_total
from vecmill.sinks.files import write_requests

@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


TURNS = "conv_id long, turn long, role string, text string"


def test_parts_go_by_rank_not_by_number(spark):
    turns = spark.createDataFrame([(1, t, "user", str(t)) for t in (5, 6, 7)], TURNS)
    parts = M.conversations(turns, max_turns=2).orderBy("part").collect()
    assert [(r["part"], [m["content"] for m in r["messages"]]) for r in parts] == [(0, ["5", "6"]), (1, ["7"])]


def test_parts_by_bytes_of_one_hot_conversation(spark):
    hot = spark.range(3000).select(
        F.lit(7).cast("long").alias("conv_id"),
        (F.col("id") * 3 + 40).alias("turn"),
        F.when(F.col("id") == 1500, "system").otherwise("user").alias("role"),
        F.when(F.col("id") == 10, F.lit(None)).otherwise(F.lpad(F.col("id").cast("string"), 10, "é")).alias("text"),
    )
    turns = hot.repartition(6).unionByName(spark.createDataFrame([(8, 0, "user", "x"), (9, 0, "system", "only")], TURNS))
    parts = M.conversations(turns, max_bytes=500).withColumn("record_id", M.record_id()).orderBy("conv_id", "part").collect()
    long = [r for r in parts if r["conv_id"] == 7]
    assert [r["part"] for r in long] == list(range(len(long))) and len(long) > 50
    assert all(r["system"].endswith("1500") for r in long)
    assert all(sum(len(m["content"].encode()) for m in r["messages"]) < 500 + 20 for r in long)
    said = [int(m["content"].lstrip("é")) for r in long for m in r["messages"]]
    assert said == [i for i in range(3000) if i not in (10, 1500)]
    assert [(r["record_id"], r["system"], len(r["messages"])) for r in parts if r["conv_id"] > 7] == [("8", None, 1), ("9", "only", 0)]
    assert long[1]["record_id"] == "7-1"
    assert M.without_content(turns).count() == 1


def test_limits_exclude_each_other(spark):
    turns = spark.createDataFrame([], TURNS)
    assert M.conversations(turns, max_turns=2).isEmpty()
    with pytest.raises(ValueError, match="not both"):
        M.conversations(turns, max_turns=2, max_bytes=2)
    with pytest.raises(ValueError, match="at least 1"):
        M.conversations(turns, max_bytes=0)


def test_running_total_over_a_key_in_several_tasks(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["before"] for r in running_total(rows, "k", [F.col("id")], F.col("v")).collect()}
    sums = {True: 0, False: 0}
    for i in range(2000):
        assert got[i] == sums[i % 3 > 0]
        sums[i % 3 > 0] += i % 7


def test_reasons_of_bad_responses(spark):
    bodies = {
        1: '{"a":{"b":[{"t":"x"}]}}', 2: "no json", 3: None, 4: '{"a":{"b":[]}}', 5: "[1]", 6: "{}", 7: '{"a":{"b":null}}',
        8: '{"a":{"b":[{"t":"x"}]},"extra":1}', 9: "", 10: "null", 11: '{"a":{"b":7}}',
    }
    rows = spark.createDataFrame(list(bodies.items()), "id int, body string")
    out = M.check_responses(rows, "body", "a struct<b:array<struct<t:string>>>", ["$.a.b"])
    got = {r["id"]: r for r in out.collect()}
    assert {i for i, r in got.items() if r["valid"]} == {1, 4, 8}
    assert got[1]["response"]["a"]["b"][0]["t"] == "x" and got[8]["body"] is None
    reasons = {i: r["reason"] for i, r in got.items() if not r["valid"]}
    assert reasons == {
        2: "not JSON", 3: "no response", 5: "other type at top", 6: "missing $.a.b", 7: "missing $.a.b", 9: "not JSON",
        10: "other type at top", 11: "other shape",
    }
    assert all(r["body"] == bodies[i] for i, r in got.items() if not r["valid"])
    assert plan_of(out).count("Scan") <= 1 and "Exchange" not in plan_of(out)


def test_equal_tables_are_compared_without_moving_rows(spark, corpus):
    same = corpus.repartition(7)
    assert differing_buckets(corpus, same) == []
    equal = count_differences(corpus, same)
    assert equal.first()[0] == 0 and "Exchange" not in plan_of(equal)


def test_one_altered_row_is_found(spark, corpus):
    least = corpus.agg(F.min("vec_id")).first()[0]
    vector = next(f.name for f in corpus.schema if f.dataType.typeName() == "array")
    altered = corpus.withColumn(vector, F.when(F.col("vec_id") == least, F.reverse(vector)).otherwise(F.col(vector)))
    assert 1 <= len(differing_buckets(corpus, altered)) <= 2
    assert count_differences(corpus, altered).first()[0] == 2


def test_digests_tell_nulls_apart(spark):
    schema = "a int, b int, c array<int>, d struct<x:int,y:int>"
    rows = [(None, 1, [1, None], (None, 1)), (1, None, [None, 1], (1, None)), (1, None, [], None), (1, None, None, None)]
    frames = [spark.createDataFrame([r], schema) for r in rows]
    for i, left in enumerate(frames):
        for j, right in enumerate(frames):
            assert count_differences(left, right).first()[0] == (0 if i == j else 2)
    doubled = frames[0].union(frames[0])
    assert rows_of(count_differences(doubled, frames[0])) == [(1,)]


def test_a_batch_has_its_minimum_of_requests(spark, tmp_path):
    requests = spark.range(99).select(F.col("id").cast("string").alias("record_id"))
    with pytest.raises(ValueError, match="99 rows, at least 100"):
        write_requests(requests, str(tmp_path / "few"))
    assert not (tmp_path / "few").exists()
    write_requests(requests.union(requests), str(tmp_path / "enough"))
    assert spark.read.json(str(tmp_path / "enough")).count() == 198
