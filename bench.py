"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR`` is the data (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated choice. Each query runs ``BENCH_RUNS`` times (default 2); its best time
counts. Results go to the ``noop`` sink, so every row is computed, and planning is part of the time.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vecmill.functions.vectors import append_scaled  # noqa: E402
from vecmill.operators.batches import map_batches  # noqa: E402
from vecmill.plans import jobs, queries  # noqa: E402
from vecmill.session import build_session, scratch_path  # noqa: E402
from vecmill.sources import versions  # noqa: E402

# Rows of the large corpus, which repeats the embedding table: eight batches of the job default.
CORPUS_ROWS = 8 * jobs.BATCH_ROWS


def large_corpus(spark: SparkSession, sf_dir: str) -> str:
    """The embedding table repeated to ``CORPUS_ROWS`` rows or a little more, in eight files."""
    corpus = queries._corpus(spark, sf_dir)
    copies = -(-CORPUS_ROWS // corpus.count())
    path = scratch_path(spark, "large-corpus")
    repeated = corpus.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    repeated.repartition(8).write.parquet(path)
    return path


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "vecmill-bench",
        master=f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = dict(queries.QUERIES)
    corpus = large_corpus(spark, sf_dir)

    def native(spark: SparkSession, _dir: str) -> DataFrame:
        return append_scaled(spark.read.parquet(corpus))

    def arrow(spark: SparkSession, _dir: str) -> DataFrame:
        return map_batches(spark.read.parquet(corpus), jobs.double_batch(), jobs.BATCH_ROWS)

    def table_job(spark: SparkSession, _dir: str) -> DataFrame:
        out = jobs.process_table(spark, corpus, scratch_path(spark, "table"), jobs.BATCH_ROWS)
        return versions.history(spark, out)

    def shards_job(spark: SparkSession, _dir: str) -> DataFrame:
        out = jobs.process_shards(spark, corpus, scratch_path(spark, "shards"), 1)
        return spark.read.parquet(out).limit(1)

    def batches_job(spark: SparkSession, _dir: str) -> DataFrame:
        out = jobs.process_batches(spark, corpus, scratch_path(spark, "batches"))
        return spark.read.parquet(out).limit(1)

    work["large_corpus_native"] = native
    work["large_corpus_map_batches"] = arrow
    # Whole jobs: read, transform, write.
    work["large_corpus_table_job"] = table_job
    work["large_corpus_shards_job"] = shards_job
    work["large_corpus_batches_job"] = batches_job
    if chosen:
        work = {name: work[name] for name in chosen.split(",")}

    seconds: dict[str, float] = {}
    for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
        for name, query in work.items():
            start = time.perf_counter()
            run(query(spark, sf_dir))
            taken = round(time.perf_counter() - start, 3)
            seconds[name] = min(taken, seconds.get(name, taken))
    spark.stop()
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    with contextlib.suppress(BrokenPipeError):
        main()
