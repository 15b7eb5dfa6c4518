"""Inputs that used to lose rows without an error."""

import os
import time

from vecmill.functions import messages as M
from vecmill.operators.sampling import mini_batches
from vecmill.plans import jobs
from vecmill.streaming.chunks import process_chunks


def test_old_files_that_arrive_late_are_ingested(spark, tmp_path):
    source, target, seen = (str(tmp_path / n) for n in ("source", "target", "seen"))
    for number in range(3):
        spark.range(number, number + 1).coalesce(1).write.mode("append").parquet(source)
        if number == 1:
            newest = max((os.path.join(source, f) for f in os.listdir(source) if f.endswith(".parquet")), key=os.path.getmtime)
            os.utime(newest, (time.time() - 30 * 86400,) * 2)
        if number != 1:
            process_chunks(spark, source, target, seen, lambda df: df)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2]


def test_long_conversations_are_one_request(spark):
    turns = spark.range(2500).selectExpr("7L conv_id", "id turn", "if(id % 1000 = 0, 'system', 'user') role", "concat('t', id) text")
    (row,) = M.conversations(turns).collect()
    assert row.system == "t0\nt1000\nt2000" and len(row.messages) == 2497 and row.messages[-1].content == "t2499"


def test_equal_names_in_different_folders_keep_their_outputs(spark, tmp_path):
    source = str(tmp_path / "sou+rce x")
    for folder, number in (("a", 1), ("b c", 2)):
        spark.createDataFrame([([number],)], "vector array<int>").coalesce(1).write.parquet(f"{source}/k={folder}")
        (file,) = (f for f in os.listdir(f"{source}/k={folder}") if f.endswith(".parquet"))
        os.link(f"{source}/k={folder}/{file}", f"{source}/k={folder}/same.parquet")
    for shard in range(2):
        out = jobs.process_shards(spark, source, str(tmp_path / "out"), 2, shard)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.vector_x2 for r in rows) == [[2], [2], [4], [4]]
    names = {r.output_file for r in rows}
    assert len(names) == 4 and {"k=a/processed_same.parquet", "k=b c/processed_same.parquet"} <= names
    listed = spark.read.parquet(jobs.manifest_path(str(tmp_path / "out"), 2)).collect()
    assert {r.output for r in listed} == names and {r.rows for r in listed} == {1}


def test_every_epoch_has_an_order_of_its_own(spark):
    ids = spark.range(100)
    first, again, second = (
        [r.id for r in mini_batches(ids, "id", 8, epoch=e).orderBy("batch", "pos").collect()] for e in (0, 0, 1)
    )
    assert first == again != second and sorted(second) == list(range(100))
