"""Chunks of bounded rows: row groups of large and small files, stops, and late files."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vecmill.plans import jobs
from vecmill.sources import row_groups
from vecmill.streaming.chunks import process_chunks


def write(folder, name, first, last, group):
    folder.mkdir(exist_ok=True)
    ids = list(range(first, last))
    table = pa.table({"id": pa.array(ids, pa.int64()), "vector": pa.array([[float(i), None] for i in ids], pa.list_(pa.float32()))})
    pq.write_table(table, folder / name, row_group_size=group)


def commits(spark, target):
    rows = spark.read.parquet(str(target)).groupBy("batch_id").agg({"id": "collect_list"}).collect()
    return [sorted(r[1]) for r in sorted(rows)]


def test_offsets_are_places_between_row_groups(tmp_path):
    write(tmp_path / "in", "a.parquet", 0, 95, 30)
    stream = row_groups.RowGroupStream(None, str(tmp_path / "in"), 70, None)
    ends = [stream.initialOffset()] + [dict(stream.latestOffset()) for _ in range(3)]
    assert [e["group"] for e in ends] == [0, 2, 4, 4]
    assert [[p.group for p in stream.partitions(a, b)] for a, b in zip(ends, ends[1:])] == [[0, 1], [2, 3], []]
    again = row_groups.RowGroupStream(None, str(tmp_path / "in"), 10, ends[1])
    # A row group that is larger than a chunk is a chunk alone.
    assert [again.latestOffset()["group"] for _ in range(2)] == [3, 4]


def test_commits_are_bounded_and_survive_stops(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    write(tmp_path / "in", "a.parquet", 0, 100, 10)
    write(tmp_path / "in", "b.parquet", 100, 115, 10)
    write(tmp_path / "in", "c.parquet", 0, 0, 10)
    (tmp_path / "in" / "_SUCCESS").touch()
    seen = []

    def transform(chunk):
        seen.append(chunk.count())
        if len(seen) == 3:
            raise InterruptedError
        return chunk

    with pytest.raises(Exception, match="InterruptedError"):
        process_chunks(spark, source, target, progress, transform, max_rows=25)
    assert [len(c) for c in commits(spark, target)] == [20, 20]
    process_chunks(spark, source, target, progress, transform, max_rows=25)
    assert commits(spark, target)[:5] == [list(range(i, i + 20)) for i in range(0, 100, 20)]
    assert commits(spark, target)[5:] == [list(range(100, 115))] and max(seen) <= 25
    # Nothing new, then a late file whose name comes first, and other sizes from there on.
    process_chunks(spark, source, target, progress, transform, max_rows=25)
    write(tmp_path / "in", "Z.parquet", 200, 260, 20)
    process_chunks(spark, source, target, progress, transform, max_rows=40)
    assert commits(spark, target)[6:] == [list(range(200, 240)), list(range(240, 260))]
    assert json.loads(row_groups.last_offset(spark, progress))["group"] == 3


def test_table_job_in_commits(spark, tmp_path):
    write(tmp_path / "in", "a.parquet", 0, 50, 10)
    out = jobs.process_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), 100, str(tmp_path / "progress"), commit_rows=20)
    rows = spark.read.parquet(out).orderBy("id").collect()
    assert [r.vector_x2 for r in rows] == [[2.0 * i, None] for i in range(50)] and {r.batch_id for r in rows} == {0, 1, 2}
