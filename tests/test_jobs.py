import os
import socket

import pytest

from conftest import rows_of
from vecmill.functions.vectors import append_scaled
from vecmill.operators.parity import count_differences
from vecmill.plans import jobs
from vecmill.sources import versions


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "corpus")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed(
        "embedding", "vector"
    ).repartition(5).write.parquet(path)
    return path


def same(spark, source, output):
    expected = append_scaled(spark.read.parquet(source))
    return count_differences(expected, output.select(*expected.columns)).first()[0] == 0


@pytest.mark.parametrize("instances", [1, 3, 8])
def test_shards_one_by_one_equal_all_at_once(spark, source, tmp_path, instances):
    whole = jobs.process_shards(spark, source, str(tmp_path / "whole"), instances)
    for shard in list(range(instances)) + [0]:
        single = jobs.process_shards(spark, source, str(tmp_path / "single"), instances, shard)
    assert whole.endswith(f"instance_count={instances}")
    assert same(spark, source, spark.read.parquet(whole))
    assert rows_of(spark.read.parquet(single)) == rows_of(spark.read.parquet(whole))


def test_table(spark, source, tmp_path):
    out = jobs.process_table(spark, source, str(tmp_path), 40)
    result = versions.read_version(spark, out)
    assert out.endswith("batch_size=40") and same(spark, source, result)
    assert len(result.inputFiles()) == 15


def test_table_from_a_versioned_source(spark, source, tmp_path):
    table = str(tmp_path / "table")
    versions.write_version(spark.read.parquet(source).limit(10), table)
    versions.write_version(spark.read.parquet(source), table)
    out = jobs.process_table(spark, table, str(tmp_path / "out"), 1000)
    assert same(spark, source, versions.read_version(spark, out))


def test_table_in_chunks(spark, source, tmp_path):
    out = jobs.process_table(
        spark, source, str(tmp_path / "out"), 100, str(tmp_path / "progress"), max_files=2
    )
    result = spark.read.parquet(out)
    assert same(spark, source, result) and result.select("batch_id").distinct().count() == 3


def test_batches_and_instances(spark, source, tmp_path):
    assert same(spark, source, spark.read.parquet(jobs.process_batches(spark, source, str(tmp_path), 7)))
    uri = f"file://{tmp_path}"
    out = jobs.process_instances(spark, f"file://{source}", uri, 2)
    assert out == f"{uri}/instance_count=2" and same(spark, source, spark.read.parquet(out))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jobs.process_instances(spark, source, uri, 2)


def test_smoke_jobs(spark):
    assert [r[0] for r in jobs.smoke_hosts(spark, 20).collect()] == [socket.gethostname()]
    assert rows_of(jobs.smoke_rows(spark)) == [
        (2022, "tiger", False),
        (2023, "rabbit", False),
        (2024, "dragon", True),
    ]
    assert jobs.smoke_rows(spark).dtypes[0] == ("year", "bigint")


def test_command_line(spark, source, tmp_path, capsys):
    jobs.main(["batches", "--local", "--source", source, "--target", str(tmp_path)])
    out = capsys.readouterr().out.strip().splitlines()[-1]
    assert same(spark, source, spark.read.parquet(out))
    jobs.main(["smoke-rows", "--local"])
    shown = capsys.readouterr().out
    assert "dragon" in shown and "from_fantasy_fiction: boolean" in shown
    assert os.path.isdir(out)
