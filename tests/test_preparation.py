import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from vecmill.functions import messages as M
from vecmill.operators import columns, metrics, ranking, sampling
from vecmill.operators.upsert import upsert
from vecmill.session import scratch_path
from vecmill.sources.runlog import Dataset, RunLog
from vecmill.sources.versions import write_version


@pytest.fixture
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def test_drop_and_rename_fail_when_absent(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert columns.drop_columns(df, "a").columns == ["b"]
    assert columns.rename_column(df, "a", "c").columns == ["c", "b"]
    for bad in (
        lambda: columns.drop_columns(df, "x"),
        lambda: columns.rename_column(df, "x", "y"),
        lambda: columns.rename_column(df, "a", "b"),
        lambda: columns.append_column(df, "a", F.lit(1)),
    ):
        with pytest.raises(ValueError):
            bad()


def test_condition_on_null_is_false(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "k string")
    out = columns.append_equals(df, "is_x", "k", "x")
    assert [r["is_x"] for r in out.collect()] == [True, False, False]


def test_replicate(spark):
    out = columns.replicate(spark.range(3), 100)
    assert out.count() == 300 and "Exchange" not in plan_of(out)
    assert out.filter("id = 1").select("rep").distinct().count() == 100


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_seeded_order_does_not_depend_on_layout(corpus, partitions):
    df = corpus.repartition(partitions)
    assert rows_of(sampling.seeded_sample(df, "vec_id", 50, 42)) == rows_of(
        sampling.seeded_sample(corpus, "vec_id", 50, 42)
    )
    ranks = sampling.seeded_rank(df.select("vec_id"), "vec_id", 42)
    assert rows_of(ranks) == rows_of(sampling.seeded_rank(corpus.select("vec_id"), "vec_id", 42))
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, 501))


def test_sample_by_rank_equals_sample_by_top_n(corpus, monkeypatch):
    small = sampling.seeded_sample(corpus, "vec_id", 77)
    assert "TakeOrderedAndProject" in plan_of(small)
    monkeypatch.setattr(sampling, "TOP_N_ROWS", 10)
    assert rows_of(sampling.seeded_sample(corpus, "vec_id", 77)) == rows_of(small)
    assert sampling.seeded_sample(corpus, "vec_id", 10_000).count() == 500
    assert rows_of(sampling.seeded_sample(corpus, "vec_id", 50, 1)) != rows_of(
        sampling.seeded_sample(corpus, "vec_id", 50, 2)
    )


def test_a_row_without_id_is_kept(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "id int")
    assert sorted(r["rank"] for r in sampling.seeded_rank(df, "id", 42).collect()) == [1, 2, 3]
    assert sampling.seeded_sample(df, "id", 3).count() == 3


def test_mini_batches(corpus):
    ids = corpus.select("vec_id")
    got = sampling.collect_batches(sampling.mini_batches(ids, "vec_id", 8), ["vec_id"])
    batches = {r["batch"]: r["vec_id"] for r in got.collect()}
    assert sorted(batches) == list(range(63))
    assert [len(batches[b]) for b in sorted(batches)] == [8] * 62 + [4]
    ranked = sampling.seeded_rank(ids, "vec_id", 42).orderBy("rank").collect()
    assert [v for b in sorted(batches) for v in batches[b]] == [r["vec_id"] for r in ranked]
    ordered = ids.withColumn("n", F.col("vec_id") + 1)
    plain = sampling.mini_batches(ordered, "vec_id", 8, shuffle=False, order_col="n")
    assert plain.filter("batch <> floor(vec_id / 8) or pos <> vec_id % 8").isEmpty()


def test_global_rank_with_few_distinct_leading_values(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    ranked = ranking.global_rank(df, [F.col("k").desc(), F.col("id").asc()])
    expected = sorted(((int(i % 3 == 0), i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    got = [(r["k"], r["id"]) for r in ranked.orderBy("rank").collect()]
    assert got == expected
    assert ranked.agg(F.max("rank"), F.min("rank"), F.count("*")).first() == (5000, 1, 5000)
    assert ranking.global_rank(df.limit(0), [F.col("id").asc()]).count() == 0


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, 3)], "p int, r int")
    assert metrics.accuracy(df, "p", "r").first() == (4, 2, 0.5)
    assert rows_of(metrics.accuracy(df, "p", "r", by="r")) == [(1, 3, 1, 1 / 3), (3, 1, 1, 1.0)]
    assert metrics.accuracy(df.limit(0), "p", "r").first()["accuracy"] is None


def test_steps(spark):
    assert metrics.steps_per_epoch(spark.range(100), 8, 3).first() == (100, 13, 39)
    steps = metrics.number_steps(spark.range(13).withColumnRenamed("id", "batch"), 3, 13)
    assert sorted(r["global_step"] for r in steps.collect()) == list(range(39))
    assert rows_of(steps.filter("epoch = 2 and batch = 12").select("global_step")) == [(38,)]


def test_minimum(spark):
    assert metrics.meets_minimum(spark.range(99), 100).first() == (99, False)
    assert metrics.require_minimum(spark.range(100), 100).count() == 100
    with pytest.raises(ValueError, match="99 rows"):
        metrics.require_minimum(spark.range(99), 100)


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", [1.0]), (None, "a", []), (3, "a", None)], "n int, s string, v array<double>"
    )
    rows = {r["column"]: r for r in metrics.dataset_profile(df, "exact").collect()}
    assert (rows["n"]["nulls"], rows["n"]["n_distinct"], rows["n"]["mean"]) == (1, 2, 2.0)
    assert (rows["s"]["lowest"], rows["s"]["highest"], rows["s"]["n_distinct"]) == ("a", "b", 2)
    assert (rows["v"]["lowest"], rows["v"]["highest"], rows["v"]["n_distinct"]) == ("0", "1", 2)
    approx = {r["column"]: r["n_distinct"] for r in metrics.dataset_profile(df).collect()}
    assert approx == {"n": 2, "s": 2, "v": 2}
    assert metrics.dataset_profile(df, None).filter("n_distinct is not null").isEmpty()


def test_upsert_takes_the_newest(spark):
    base = spark.createDataFrame([("1", "a", 9), ("2", "b", 1)], "_id string, title string, seq int")
    updates = spark.createDataFrame(
        [("1", "c", 1), ("3", "d", 1), ("3", "e", 2)], "_id string, title string, seq int"
    )
    out = upsert(base, updates, "_id", "seq")
    assert rows_of(out) == [("1", "c", 1), ("2", "b", 1), ("3", "e", 2)]


def test_upsert_leaves_other_base_rows(spark, monkeypatch):
    base = spark.createDataFrame([("1", 1), ("1", 2), (None, 3), (None, 4), ("2", 5)], "_id string, v int")
    none, some = base.limit(0), spark.createDataFrame([("2", 9)], "_id string, v int")
    assert rows_of(upsert(base, none, "_id")) == rows_of(base)
    expected = sorted([("1", 1), ("1", 2), (None, 3), (None, 4), ("2", 9)], key=repr)
    out = upsert(base, some, "_id")
    assert rows_of(out) == expected and "Exchange hashpartitioning" not in plan_of(out)
    monkeypatch.setattr("vecmill.operators.upsert.BROADCAST_BYTES", 0)
    assert rows_of(upsert(base, some, "_id")) == expected


@pytest.mark.parametrize("rows", [[("1", 1), ("1", 2)], [(None, 1)]])
def test_upsert_without_a_newest_update_fails(spark, rows):
    base = spark.createDataFrame([("1", 0)], "_id string, v int")
    with pytest.raises(Exception, match="update"):
        upsert(base, spark.createDataFrame(rows, "_id string, v int"), "_id").collect()
    tied = spark.createDataFrame([("1", 1, 7), ("1", 2, 7)], "_id string, v int, seq int")
    with pytest.raises(Exception, match="none the newest"):
        upsert(base.withColumn("seq", F.lit(0)), tied, "_id", "seq")


def test_requests(spark, sf_dir):
    turns = spark.createDataFrame(
        [
            (1, 0, "system", "be brief"),
            (1, 2, "assistant", "yes"),
            (1, 1, "user", 'Hé "you"\n'),
            (2, 0, "user", "alone"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    out = {r["conv_id"]: r for r in M.conversations(turns).collect()}
    assert out[1]["system"] == "be brief" and out[2]["system"] is None
    assert [tuple(m) for m in out[1]["messages"]] == [("user", 'Hé "you"\n'), ("assistant", "yes")]
    body = M.conversations(turns).filter("conv_id = 1").select(M.request_json("messages", "system"))
    text = body.first()[0]
    assert json.loads(text) == {
        "anthropic_version": M.FORMAT_VERSION,
        "max_tokens": 1000,
        "system": "be brief",
        "messages": [
            {"role": "user", "content": 'Hé "you"\n'},
            {"role": "assistant", "content": "yes"},
        ],
    }
    assert list(json.loads(text)) == ["anthropic_version", "max_tokens", "system", "messages"]


def test_a_very_long_conversation_is_continued(spark):
    """One conversation holds most rows: it is cut into parts, and nothing is lost."""
    long = spark.range(2500).select(
        F.lit(7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "system").otherwise("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    short = spark.range(100).select(
        (F.col("id") + 100).alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.lit("user").alias("role"),
        F.lit("x").alias("text"),
    )
    parts = M.conversations(long.union(short), max_turns=1000)
    hot = sorted((r["part"], r["system"], len(r["messages"])) for r in parts.filter("conv_id = 7").collect())
    assert hot == [(0, "0", 999), (1, "0", 1000), (2, "0", 500)]
    said = parts.filter("conv_id = 7").orderBy("part").collect()
    assert [m["content"] for r in said for m in r["messages"]] == [str(i) for i in range(1, 2500)]
    assert parts.filter("conv_id >= 100").count() == 100


def test_bad_responses_are_set_aside(spark):
    rows = [(1, '{"a":{"b":[{"t":"x"}]}}'), (2, "no json"), (3, None), (4, '{"a":{"b":[]}}')]
    good, bad = M.parse_responses(
        spark.createDataFrame(rows, "id int, body string"), "body", "a struct<b:array<struct<t:string>>>"
    )
    assert rows_of(good.select("id", F.get("response.a.b", F.lit(0))["t"])) == [(1, "x"), (4, None)]
    assert rows_of(bad.select("id", "body")) == [(2, "no json"), (3, None)]


def test_run_log(spark, corpus, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    run = log.start_run("first", "a run", "tests")
    other = log.start_run("second", run_id="mine")
    assert other == "mine"
    log.log_params(run, {"num_epochs": 2, "learning_rate": 5e-5})
    log.log_params(run, {})
    log.log_text(run, '{"role": "user"}', "user_message.json")
    log.log_metric(run, "test_accuracy", 0.5)
    series = spark.range(26).select(
        F.lit("train_loss").alias("key"), (F.lit(1.0) / (F.col("id") + 1)).alias("metric"), F.col("id").alias("step")
    )
    log.log_metrics(run, series)
    assert rows_of(log.last_per_epoch(run, "train_loss", 13)) == [(0, 1 / 13), (1, 1 / 26)]
    assert rows_of(log.entries(run, "param").select("key", "value")) == [
        ("learning_rate", "5e-05"),
        ("num_epochs", "2"),
    ]
    tags = dict(rows_of(log.entries(run, "tag").select("key", "value")))
    assert tags == {"run_name": "first", "run_description": "a run", "use_case": "tests"}
    assert log.entries("mine").count() == 3
    assert log.entries(run, "metric").count() == 27


def test_tracked_datasets(spark, corpus, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    table = str(tmp_path / "table")
    write_version(corpus, table)
    run = log.start_run("r")
    log.log_datasets(run, {"d_train": table})
    write_version(corpus.limit(5), table)
    log.log_datasets(run, {"d_test": table, "d_old": Dataset(table, 0)})
    found = log.tracked_datasets(run)
    assert {k: v.version for k, v in found.items()} == {
        "dataset_d_train_metadata": 0,
        "dataset_d_test_metadata": 1,
        "dataset_d_old_metadata": 0,
    }
    assert found["dataset_d_train_metadata"].read(spark).count() == 500
    assert log.tracked_datasets("unknown") == {}


def test_scratch_paths_are_under_the_shared_folder(spark):
    assert scratch_path(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
