import os
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import plan_of, rows_of
from vecmill.functions.vectors import append_scaled
from vecmill.operators.columns import conform
from vecmill.operators.shards import append_shard, file_shards, read_shard, shard_files
from vecmill.session import scratch_path, shared_dir, size_shuffles
from vecmill.sinks import files as sinks
from vecmill.sources import files as sources
from vecmill.sources import versions
from vecmill.streaming.chunks import process_chunks, write_chunk


@pytest.fixture
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")


@pytest.fixture
def split_corpus(corpus, tmp_path):
    path = str(tmp_path / "in put")
    corpus.repartition(5).write.parquet(path)
    return path


def names(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".parquet"))


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_shuffles_are_sized_by_input(spark):
    other = spark.newSession()
    assert size_shuffles(other, 1) == 8
    assert size_shuffles(other, 100 << 40) == 409_600
    assert other.conf.get("spark.sql.shuffle.partitions") == "409600"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_read_by_path_uri_and_list(spark, sf_dir, corpus):
    file = f"{sf_dir}/embeddings.parquet"
    assert sources.read_parquet(spark, file).count() == corpus.count()
    assert sources.read_parquet(spark, f"file://{file}").count() == corpus.count()
    assert sources.read_parquet(spark, [file, file]).count() == 2 * corpus.count()


def test_file_rows_reads_no_column(spark, split_corpus, corpus):
    rows = sources.file_rows(spark, split_corpus)
    assert rows.count() == 5 and rows.agg(F.sum("rows")).first()[0] == corpus.count()
    assert "ReadSchema: struct<>" in plan_of(rows)


def test_dataset_bytes(spark, split_corpus):
    expected = sum(os.path.getsize(os.path.join(split_corpus, f)) for f in names(split_corpus))
    assert sources.dataset_bytes(spark, split_corpus) == expected


def test_uri_helpers(spark):
    df = spark.createDataFrame([("s3://bucket/a/b.parquet",), ("b.parquet",)], "uri string")
    out = df.select(
        sources.base_name("uri"),
        sources.without_prefix("uri", "s3://bucket/"),
        sources.processed_name(sources.base_name("uri")),
    )
    assert rows_of(out) == [
        ("b.parquet", "a/b.parquet", "processed_b.parquet"),
        ("b.parquet", "b.parquet", "processed_b.parquet"),
    ]


def test_splits_are_pruned(spark, corpus, tmp_path):
    path = str(tmp_path / "splits")
    corpus.withColumn("split", F.when(F.col("label") < 5, "train").otherwise("test")).write.partitionBy(
        "split"
    ).parquet(path)
    train = sources.read_split(spark, path, "train")
    assert "split" not in train.columns
    assert train.count() + sources.read_split(spark, path, "test").count() == corpus.count()
    assert "PartitionFilters: [isnotnull(split" in plan_of(train)


def test_spread(spark, sf_dir, split_corpus):
    one = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert sources.spread(one, "vec_id").rdd.getNumPartitions() == 8
    assert sources.spread(spark.read.parquet(split_corpus), "vec_id").count() == one.count()


def test_large_scans_are_not_spread(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sources, "SPREAD_BYTES", 1)
    one = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert "Exchange" not in plan_of(sources.spread(one, "vec_id"))


def test_write_states_its_mode_and_schema(spark, corpus, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_dataset(corpus, path, "error")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_dataset(corpus, path, "error")
    declared = T.StructType.fromDDL("label int, vec_id long, vector array<float>")
    sinks.write_dataset(corpus, path, "overwrite", declared)
    assert spark.read.parquet(path).columns == ["label", "vec_id", "vector"]
    with pytest.raises(TypeError, match="label"):
        conform(corpus, T.StructType.fromDDL("label long, vec_id long, vector array<float>"))


def test_empty_input_gives_an_empty_table(spark, corpus, tmp_path):
    path = str(tmp_path / "empty")
    sinks.write_dataset(append_scaled(corpus.limit(0)), path, "error")
    out = spark.read.parquet(path)
    assert out.count() == 0 and out.columns[-1] == "vector_x2"


def test_vectors_are_written_without_dictionary(spark, corpus, tmp_path):
    path = tmp_path / "out"
    sinks.write_dataset(append_scaled(corpus), str(path), "error")
    (file,) = names(path)
    group = pq.ParquetFile(path / file).metadata.row_group(0)
    dictionary = {
        group.column(i).path_in_schema: any("DICTIONARY" in e for e in group.column(i).encodings)
        for i in range(group.num_columns)
    }
    assert dictionary.pop("label")
    dictionary.pop("vec_id")
    assert dictionary == {"vector.list.element": False, "vector_x2.list.element": False}


def test_one_output_per_input(spark, split_corpus, tmp_path):
    out = str(tmp_path / "out")
    tagged = sinks.with_output_name(spark.read.parquet(split_corpus), sources.source_root(spark, split_corpus))
    assert "Exchange" not in plan_of(tagged)
    sinks.write_per_input(append_scaled(tagged), out)
    outputs = sorted(d for d in os.listdir(out) if d.startswith("output_file="))
    assert outputs == [f"output_file=processed_{n}" for n in names(split_corpus)]


def test_parameter_is_in_the_path(spark, corpus, tmp_path):
    path = str(tmp_path / "out")
    for size in (64, 128, 128):
        sinks.write_parameterised(corpus, path, batch_size=size, run="a")
    out = spark.read.parquet(path)
    assert rows_of(out.groupBy("batch_size").count()) == [(128, 500), (64, 500)]
    assert "PartitionFilters: [isnotnull(batch_size" in plan_of(out.filter("batch_size = 64"))


def test_compaction_without_shuffle(spark, corpus, tmp_path):
    small, big, tiny = (str(tmp_path / n) for n in ("small", "big", "tiny"))
    corpus.repartition(20).write.parquet(small)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sinks.compact(spark, small, big)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len(names(big)) == 1 == sinks.compacted_files(spark, small)
    assert rows_of(spark.read.parquet(big)) == rows_of(corpus)
    total = sources.dataset_bytes(spark, small)
    sinks.compact(spark, small, tiny, target_bytes=total // 4)
    assert 4 <= len(names(tiny)) <= 6
    sinks.compact(spark, small, big, mode="overwrite", max_rows_per_file=100)
    assert len(names(big)) == 5


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.write_json_lines(spark.createDataFrame([(1, "é\n")], "a int, b string"), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"a":1,"b":"é\\n"}']
    sinks.write_json_lines(spark.createDataFrame([("{}",)], "x string"), path, "overwrite")
    assert [r[0] for r in spark.read.text(path).collect()] == ["{}"]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_disjoint_complete_and_even(spark, split_corpus, corpus, shards):
    scan = spark.read.parquet(split_corpus)
    sizes = [0] * shards
    for _, shard in shard_files(scan, shards):
        sizes[shard] += 1
    assert sum(sizes) == 5 and max(sizes) - min(sizes) <= 1
    parts = [read_shard(spark, split_corpus, s, shards) for s in range(shards)]
    assert sum(p.count() for p in parts) == corpus.count()
    tagged = append_shard(scan, shards).groupBy("shard").count()
    expected = [(s, parts[s].count()) for s in range(shards) if parts[s].count()]
    assert rows_of(tagged) == sorted(expected, key=repr)
    assert file_shards(scan, shards).count() == 5


def test_versions(spark, corpus, tmp_path):
    path = str(tmp_path / "table")
    assert versions.latest_version(spark, path) is None
    assert versions.history(spark, path).count() == 0
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, path)
    assert versions.write_version(corpus, path) == 0
    half = versions.read_version(spark, path).filter("label < 5")
    assert versions.write_version(half, path) == 1
    assert versions.read_version(spark, path).count() == half.count()
    assert versions.read_version(spark, path, 0).count() == corpus.count()
    with pytest.raises(ValueError, match="no version 7"):
        versions.read_version(spark, path, 7)
    history = versions.history(spark, path).select("version", "operation", "rows")
    assert rows_of(history) == [(0, "overwrite", 500), (1, "overwrite", half.count())]
    assert sources.list_files(versions.read_version(spark, path, 0))
    versions.export_version(spark, path, str(tmp_path / "flat"), 0)
    assert spark.read.parquet(str(tmp_path / "flat")).count() == corpus.count()


def test_empty_version(spark, corpus, tmp_path):
    path = str(tmp_path / "table")
    assert versions.write_version(corpus.limit(0), path) == 0
    assert versions.read_version(spark, path).isEmpty()
    assert versions.history(spark, path).first()["rows"] == 0


def test_unfinished_version_is_invisible_and_reused(spark, corpus, tmp_path):
    path = str(tmp_path / "table")
    versions.write_version(corpus, path)
    corpus.limit(3).write.parquet(f"{path}/data/version=1")
    assert versions.latest_version(spark, path) == 0
    assert versions.write_version(corpus.limit(7), path) == 1
    assert versions.read_version(spark, path).count() == 7


def test_failed_version_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.write_version(spark.createDataFrame([([1],)], "vector array<tinyint>"), path)
    bad = append_scaled(spark.createDataFrame([([100],)], "vector array<tinyint>"))
    with pytest.raises(Exception, match="OVERFLOW"):
        versions.write_version(bad, path)
    assert versions.latest_version(spark, path) == 0
    assert versions.read_version(spark, path).columns == ["vector"]


def test_delta_is_asked_for_by_format(spark, corpus, tmp_path):
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND|delta"):
        versions.read_version(spark, str(tmp_path), table_format="delta")
    with pytest.raises(ValueError, match="table_format"):
        versions.write_version(corpus, str(tmp_path), table_format="other")


def test_chunks_restart_and_continue(spark, corpus, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    corpus.filter("label < 5").repartition(3).write.parquet(source)
    corpus.limit(2).write.parquet(target)
    process_chunks(spark, source, target, progress, append_scaled, max_files=1)
    first = spark.read.parquet(target)
    assert rows_of(first.select("batch_id").distinct()) == [(0,), (1,), (2,)]
    assert first.count() == corpus.filter("label < 5").count()
    # Nothing new: nothing changes. New files: only they are added.
    process_chunks(spark, source, target, progress, append_scaled, max_files=1)
    corpus.filter("label >= 5").coalesce(1).write.mode("append").parquet(source)
    process_chunks(spark, source, target, progress, append_scaled, max_files=1)
    out = spark.read.parquet(target)
    assert out.select("batch_id").distinct().count() == 4
    assert rows_of(out.drop("batch_id")) == rows_of(append_scaled(corpus))


def test_repeated_chunk_changes_nothing(spark, corpus, tmp_path):
    target = str(tmp_path / uuid.uuid4().hex)
    for number in (0, 1, 1, 2, 1):
        write_chunk(corpus.filter(F.col("label") == number), target, number)
    out = spark.read.parquet(target)
    assert rows_of(out.drop("batch_id")) == rows_of(corpus.filter("label < 3"))


def test_failing_chunk_resumes(spark, corpus, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    corpus.repartition(3).write.parquet(source)
    seen = []

    def fails_once(df):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return append_scaled(df)

    with pytest.raises(Exception, match="lost"):
        process_chunks(spark, source, target, progress, fails_once, max_files=1)
    assert spark.read.parquet(target).select("batch_id").distinct().count() == 1
    process_chunks(spark, source, target, progress, fails_once, max_files=1)
    assert rows_of(spark.read.parquet(target).drop("batch_id")) == rows_of(append_scaled(corpus))
