"""Registered queries: ``(spark, sf_dir) -> DataFrame``, each over whole tables.

Array results are returned one element to a row, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.functions import messages as M
from vecmill.functions.text import words
from vecmill.functions.vectors import append_scaled, argmax, cast_elements
from vecmill.operators import batches, columns, index, metrics, parity, sampling, search, shards, tokenizing
from vecmill.operators.upsert import upsert
from vecmill.plans import jobs
from vecmill.session import cut_lineage, scratch_path
from vecmill.sinks import files as sinks
from vecmill.sources import files as sources
from vecmill.sources import versions
from vecmill.sources.runlog import RunLog
from vecmill.streaming.chunks import process_chunks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Parameters of the queries; the SQL counterparts use the same.
SEED = 42
SAMPLE = 100
LOADER_BATCH = 8
EPOCHS = 2
REPORT_BATCH = 128
# Row groups of a large file, and how many of them a commit has room for.
ROW_GROUPS = 10
COMMIT_GROUPS = 2
SHARDS = 3
PART_BYTES = 1000
REQUEST_MINIMUM = 10
COPIES = 100
TOP_K = 10
SYSTEM_PROMPT = "Answer in one sentence."
MATCH_QUERIES = {"frequent": "the and Que der", "single": "ontion", "repeated": "eau eau los"}
SPARSE_QUERIES = {
    "broad": {"the": 0.5, "que": 1.25, "der": 2.0, "los": 0.75},
    "narrow": {"ontion": 1.5, "eau": 0.25},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.spread(_table(spark, sf_dir, "documents"), "doc_id")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table under the column name that the jobs expect."""
    return columns.rename_column(_table(spark, sf_dir, "embeddings"), "embedding", "vector")


def _corpus_files(spark: SparkSession, sf_dir: str) -> str:
    """A copy of the corpus in several files."""
    path = scratch_path(spark, "corpus")
    _corpus(spark, sf_dir).repartition(5).write.parquet(path)
    return path


def _foldered_corpus(spark: SparkSession, sf_dir: str) -> str:
    """A copy of the corpus in a folder for each label, with one and the same file name in all of
    them, and a folder ``label=-1`` whose file has no rows."""
    path = scratch_path(spark, "foldered")
    corpus = _corpus(spark, sf_dir)
    corpus.coalesce(1).write.partitionBy("label").parquet(path)
    corpus.drop("label").limit(0).coalesce(1).write.parquet(f"{path}/label=-1")
    return path


def _plain_part(column: str) -> Column:
    """A path without what Spark adds to the name of a written file."""
    return F.regexp_replace(column, "part-[^/]*", "part")


def _elements(df: DataFrame, vector: str = "vector_x2") -> DataFrame:
    return df.select("vec_id", "label", F.posexplode(vector).alias("dim", vector)).withColumn(
        "dim", F.col("dim").cast("long")
    )


# Sources


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select(
        "vec_id", "label", F.size("vector").cast("long").alias("n_dims")
    )


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [
        metrics.row_count(_table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "rows")
        for t in TABLES
    ]
    return _union(counts)


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the files of all tables, and of a corpus with equal names in its folders."""
    root, path = sources.source_root(spark, sf_dir), _foldered_corpus(spark, sf_dir)
    tables = sources.file_rows(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES], root)
    foldered = sources.file_rows(spark, path, sources.source_root(spark, path))
    return tables.unionByName(foldered.withColumn("file_name", _plain_part("file_name")))


def file_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per file of a corpus with equal names in its folders, and the shard of the file."""
    path = _foldered_corpus(spark, sf_dir)
    root = sources.source_root(spark, path)
    assigned = shards.file_shards(sources.read_parquet(spark, path), SHARDS).select(
        sources.relative_path(root, "file_path").alias("file_name"), F.col("shard").cast("long").alias("shard")
    )
    rows = sources.file_rows(spark, path, root).join(assigned, "file_name")
    return rows.withColumn("file_name", _plain_part("file_name"))


def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(
        "page_id",
        sources.base_name("url").alias("base"),
        sources.without_prefix("url", "http://").alias("key"),
        sources.processed_name(sources.base_name("url")).alias("processed"),
    )


def split_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by split (labelled ones for training), then read split by split."""
    docs = _table(spark, sf_dir, "documents")
    labelled = _table(spark, sf_dir, "labels").select("doc_id", F.lit("train").alias("split"))
    path = scratch_path(spark, "splits")
    split = F.coalesce("split", F.lit("test")).alias("split")
    tagged = docs.join(labelled, "doc_id", "left").select(*docs.columns, split)
    tagged.write.partitionBy("split").parquet(path)
    return _union(
        [
            sources.read_split(spark, path, s).select(
                "doc_id", "lang", "n_chars", F.lit(s).alias("split")
            )
            for s in ("train", "test")
        ]
    )


# Core transformation and its forms


def vector_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(append_scaled(_corpus(spark, sf_dir)))


def vector_scale_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On doubles that float32 cannot hold."""
    doubles = cast_elements(_corpus(spark, sf_dir), "vector", "double")
    thirds = doubles.withColumn("vector", F.transform("vector", lambda x: x / 3))
    return _elements(append_scaled(thirds, via="float32"))


def map_batches_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(
        batches.map_batches(_corpus(spark, sf_dir), jobs.double_batch(), REPORT_BATCH)
    )


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = batches.chunk_report(_corpus(spark, sf_dir), REPORT_BATCH)
    return report.agg(
        F.sum("rows").alias("rows"), (F.max("rows") <= REPORT_BATCH).alias("within_batch_size")
    )


def write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "roundtrip")
    sinks.write_dataset(append_scaled(_corpus(spark, sf_dir)), path, "error")
    return _elements(sources.read_parquet(spark, path))


def shard_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs, outputs and their rows as the sharded job lists them, shard by shard, and the rows
    and the sum of elements that are in each output."""
    source, target = _foldered_corpus(spark, sf_dir), scratch_path(spark, "sharded")
    for shard in range(SHARDS):
        out = jobs.process_shards(spark, source, target, SHARDS, shard)
    total = F.aggregate("vector_x2", F.lit(0.0), lambda a, x: a + x)
    written = sources.read_parquet(spark, out).groupBy(F.col("output_file").alias("output"), "label").agg(
        F.count("*").alias("rows_written"), F.round(F.sum(total), 3).alias("total")
    )
    listed = sources.read_parquet(spark, jobs.manifest_path(target, SHARDS)).drop("part")
    return listed.join(written, "output", "left").select(
        _plain_part("input").alias("input"),
        _plain_part("output").alias("output"),
        "rows",
        F.coalesce("rows_written", F.lit(0)).alias("rows_written"),
        "label",
        "total",
    )


def overwrite_then_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunked job, two files to a chunk: the first chunk replaces the target, others add."""
    source, target = _corpus_files(spark, sf_dir), scratch_path(spark, "chunked")
    progress = scratch_path(spark, "progress")
    out = jobs.process_table(spark, source, target, REPORT_BATCH, progress, max_files=2)
    return _elements(sources.read_parquet(spark, out))


def incremental_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in two deliveries, each ingested when it is there."""
    events = _table(spark, sf_dir, "events")
    source, target = scratch_path(spark, "arrived"), scratch_path(spark, "ingested")
    progress = scratch_path(spark, "progress")
    late = F.col("event_type").isin("purchase", "error")
    for delivery in (events.filter(~late), events.filter(late)):
        delivery.repartition(2).write.mode("append").parquet(source)
        process_chunks(spark, source, target, progress, lambda df: df)
    return sources.read_parquet(spark, target).select(
        "event_id", "user_id", "event_type", "value", "props"
    )


def row_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of events, committed in chunks of bounded rows; the job stops after two and goes on."""
    source, target = scratch_path(spark, "large-file"), scratch_path(spark, "row-commits")
    progress, done = scratch_path(spark, "progress"), []
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    ordered = events.coalesce(1).sortWithinPartitions("event_id")
    group = -(-events.count() // ROW_GROUPS)
    ordered.write.option("parquet.block.row.count.limit", group).parquet(source)
    most = group * COMMIT_GROUPS + group // 2

    def stopping(chunk: DataFrame) -> DataFrame:
        if len(done) == 2:
            raise InterruptedError("stopped on purpose")
        done.append(chunk)
        return chunk

    try:
        process_chunks(spark, source, target, progress, stopping, max_rows=most)
    except StreamingQueryException:
        process_chunks(spark, source, target, progress, lambda df: df, max_rows=most)
    return sources.read_parquet(spark, target).withColumn("batch_id", F.col("batch_id").cast("long"))


def param_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-parameter")
    scaled = append_scaled(_corpus(spark, sf_dir))
    for size in (64, REPORT_BATCH, REPORT_BATCH):
        sinks.write_parameterised(scaled, path, batch_size=size)
    return sources.read_parquet(spark, path).select(
        "vec_id", "label", F.col("batch_size").cast("long").alias("batch_size")
    )


def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, dest = _corpus_files(spark, sf_dir), scratch_path(spark, "compacted")
    sinks.compact(spark, source, dest)
    return _elements(append_scaled(sources.read_parquet(spark, dest)))


def strategy_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each job's output, and how many differ from the plain projection."""
    source = _corpus_files(spark, sf_dir)
    target = scratch_path(spark, "strategies")
    table = jobs.process_table(spark, source, f"{target}/table", REPORT_BATCH)
    outputs = {
        "shards": sources.read_parquet(
            spark, jobs.process_shards(spark, source, f"{target}/shards", SHARDS)
        ).drop("output_file"),
        "table": versions.read_version(spark, table),
        "batches": sources.read_parquet(
            spark, jobs.process_batches(spark, source, f"{target}/batches")
        ),
        "small_batches": sources.read_parquet(
            spark, jobs.process_batches(spark, source, f"{target}/batches", REPORT_BATCH)
        ),
        "instances": sources.read_parquet(
            spark, jobs.process_instances(spark, source, f"{target}/instances", SHARDS)
        ),
    }
    plain = append_scaled(_corpus(spark, sf_dir))
    rows = []
    for name, output in outputs.items():
        differences = parity.count_differences(plain, output.select(*plain.columns))
        rows.append(
            metrics.row_count(output).select(
                F.lit(name).alias("strategy"), "rows", differences.scalar().alias("differences")
            )
        )
    return _union(rows)


# Versions and the run log


def _two_versions(spark: SparkSession, sf_dir: str) -> str:
    """Version 0 is the corpus, version 1 the scaled corpus."""
    path = scratch_path(spark, "versioned")
    versions.write_version(_corpus(spark, sf_dir), path)
    scaled = append_scaled(versions.read_version(spark, path), output="vector", replace=True)
    versions.write_version(scaled, path)
    return path


def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(versions.read_version(spark, _two_versions(spark, sf_dir)), "vector")


def version_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(versions.read_version(spark, _two_versions(spark, sf_dir), 0), "vector")


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = versions.history(spark, _two_versions(spark, sf_dir))
    return history.select("version", "operation", "rows")


def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = scratch_path(spark, "exported")
    versions.export_version(spark, _two_versions(spark, sf_dir), dest)
    return _elements(sources.read_parquet(spark, dest), "vector")


def tracked_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log a pinned dataset with a run, find it by the run, read it back."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    run = log.start_run("corpus", "embedding corpus", "tests")
    log.log_datasets(run, {"corpus_train": _two_versions(spark, sf_dir)})
    return _elements(log.tracked_datasets(run)["dataset_corpus_train_metadata"].read(spark), "vector")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric per training step, logged and read back, and its last value in each epoch."""
    log = RunLog(spark, scratch_path(spark, "runs"))
    run = log.start_run("training", use_case="tests")
    log.log_params(run, {"num_epochs": EPOCHS, "batch_size": LOADER_BATCH})
    batched = sampling.mini_batches(_corpus(spark, sf_dir), "vec_id", LOADER_BATCH, SEED)
    per_batch = batched.groupBy("batch").agg(F.avg("label").alias("loss"))
    epoch_steps = metrics.steps_per_epoch(_corpus(spark, sf_dir), LOADER_BATCH, EPOCHS)
    per_epoch = epoch_steps.first()["steps_per_epoch"]
    steps = metrics.number_steps(per_batch, EPOCHS, per_epoch)
    log.log_metrics(
        run,
        steps.select(
            F.lit("train_loss").alias("key"),
            (F.col("loss") / (F.col("epoch") + 1)).alias("metric"),
            F.col("global_step").alias("step"),
        ),
    )
    log.log_metrics(
        run,
        log.last_per_epoch(run, "train_loss", per_epoch).select(
            F.lit("epoch_loss").alias("key"), "metric", F.col("epoch").alias("step")
        ),
    )
    return log.entries(run, "metric").select("key", "step", "metric")


# Columns


def conditional_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "event_type")
    return columns.append_equals(events, "is_purchase", "event_type", "purchase")


def drop_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = columns.drop_columns(_table(spark, sf_dir, "labels"), "toxic")
    return columns.rename_column(labels, "quality", "labels")


def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("vec_id", argmax("vector").alias("prediction"))


def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unlabelled entries for each document, both replaced by the later of two labels."""
    base = _table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"), F.explode(F.array(F.lit(0), F.lit(9))).alias("seq")
    )
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    later = labels.withColumn("seq", F.lit(2))
    earlier = labels.select("doc_id", F.lit(-2).alias("quality"), F.lit(-2).alias("toxic"), F.lit(1).alias("seq"))
    return upsert(base, later.unionByName(earlier), "doc_id", "seq")


# Samples, batches, metrics


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir).select("vec_id", "label")
    return sampling.seeded_sample(corpus, "vec_id", SAMPLE, SEED)


def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of each epoch, every epoch in an order of its own."""
    corpus = _corpus(spark, sf_dir).select("vec_id", "label")
    epochs = []
    for epoch in range(EPOCHS):
        batched = sampling.mini_batches(corpus, "vec_id", LOADER_BATCH, SEED, epoch=epoch)
        collected = sampling.collect_batches(batched, ["vec_id", "label"])
        epochs.append(collected.withColumn("epoch", F.lit(epoch).cast("long")))
    return _union(epochs).select(
        "epoch",
        "batch",
        F.array_join(F.col("vec_id").cast("array<string>"), ",").alias("vec_ids"),
        F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"),
    )


def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.steps_per_epoch(_corpus(spark, sf_dir), LOADER_BATCH, EPOCHS)


def step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir).select("vec_id")
    batched = sampling.mini_batches(corpus, "vec_id", LOADER_BATCH, SEED)
    per_batch = batched.groupBy("batch").agg(F.count("*").alias("rows"))
    per_epoch = metrics.steps_per_epoch(corpus, LOADER_BATCH, EPOCHS).select("steps_per_epoch")
    steps = metrics.number_steps(per_batch, EPOCHS, per_epoch.scalar())
    return steps.withColumn("epoch", F.col("epoch").cast("long"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = argmax("vector") % 10
    return _corpus(spark, sf_dir).select("label", classes.alias("prediction"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_predictions(spark, sf_dir), "prediction", "label")


def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_predictions(spark, sf_dir), "prediction", "label", by="label")


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [
        metrics.dataset_profile(_table(spark, sf_dir, t), distinct="exact").select(
            F.lit(t).alias("table_name"),
            F.col("column").alias("column_name"),
            "rows",
            "nulls",
            "n_distinct",
            "lowest",
            "highest",
            F.round("mean", 6).alias("mean"),
        )
        for t in ("documents", "labels", "conversations")
    ]
    return _union(profiles)


def array_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = metrics.dataset_profile(_table(spark, sf_dir, "embeddings"), distinct=None)
    return profile.filter(F.col("column") == "embedding").select(
        "rows", "nulls", "lowest", "highest", "mean"
    )


def fanout_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per user that has events, gathered and reduced to distinct results."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return batches.fan_out(users, lambda user: f"user-{user}").distinct()


# Text


def tokenize_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenized = tokenizing.tokenize(_documents(spark, sf_dir))
    real = F.size(F.array_remove("attention_mask", 0))
    return tokenized.select(
        "doc_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.size("tokens").cast("long").alias("length"),
        real.cast("long").alias("n_real"),
        F.array_join("tokens", " ").alias("tokens"),
    )


def token_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.build_vocabulary(_documents(spark, sf_dir))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    vocabulary = cut_lineage(tokenizing.build_vocabulary(docs), "vocabulary")
    ids = tokenizing.token_ids(docs, vocabulary, "doc_id")
    real = F.size(F.array_remove("attention_mask", 0))
    return ids.select(
        "doc_id",
        F.size("input_ids").cast("long").alias("length"),
        real.cast("long").alias("n_real"),
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
    )


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = search.match_topk(docs, "doc_id", "text", MATCH_QUERIES, TOP_K)
    return hits.select(
        "query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def benchmark_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every text of ``benchmark`` as a query."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    hits = search.match_topk(_documents(spark, sf_dir), "doc_id", "text", items, TOP_K)
    return hits.select(
        "query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits as ``benchmark_topk``, from an index that is written first."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    path = scratch_path(spark, "index")
    index.build_index(_documents(spark, sf_dir), "doc_id", "text", path)
    return index.index_topk(spark, path, items, TOP_K, "doc_id").select(
        "query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def _term_weights(batch: pa.Table) -> pa.Table:
    """A stand-in for a sparse model: relative term frequencies."""
    lists = batch["words"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    placed = pa.table({"doc": np.repeat(np.arange(len(lists)), lengths), "term": lists.flatten()})
    counts = placed.group_by(["doc", "term"]).aggregate([([], "count_all")]).sort_by("doc")
    doc = counts["doc"].to_numpy()
    offsets = np.searchsorted(doc, np.arange(len(lists) + 1)).astype(np.int32)
    weights = pa.array(counts["count_all"].to_numpy() / lengths[doc])
    terms = counts["term"].combine_chunks()
    sparse = pa.MapArray.from_arrays(pa.array(offsets), terms, weights)
    return batch.drop_columns("words").append_column("sparse", sparse)


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", words("text").alias("words"))
    indexed = search.reindex(docs, _term_weights)
    hits = search.sparse_topk(indexed, "doc_id", "sparse", SPARSE_QUERIES, TOP_K)
    return hits.select(
        "query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def _count_words(batch: pa.Table) -> pa.Table:
    n = pc.count_substring_regex(batch["text"], pattern="[A-Za-z]+")
    return batch.drop_columns("text").append_column("n_words", n.cast(pa.int64()))


def reindex_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    return search.reindex(docs, _count_words)


# Requests and responses


def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON lines and read back, one message to a row."""
    path = scratch_path(spark, "requests")
    turns = _table(spark, sf_dir, "conversations")
    system = F.coalesce("system", F.lit(SYSTEM_PROMPT))
    requests = M.conversations(turns).select(
        F.col("conv_id").cast("string").alias("record_id"),
        M.request_json("messages", system).alias("body"),
    )
    sinks.write_json_lines(requests, path)
    lines = spark.read.schema("record_id string, body string").json(path)
    request = lines.withColumn("r", F.from_json("body", M.REQUEST))
    return request.select(
        F.col("record_id").cast("long").alias("conv_id"),
        "r.anthropic_version",
        F.col("r.max_tokens").cast("long").alias("max_tokens"),
        "r.system",
        F.posexplode("r.messages").alias("pos", "m"),
    ).select(
        "conv_id",
        "anthropic_version",
        "max_tokens",
        "system",
        F.col("pos").cast("long").alias("pos"),
        "m.role",
        "m.content",
    )


def request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long conversations cut by the bytes of their turns; each part is a request with its own name,
    written when there are enough of them."""
    path = scratch_path(spark, "request-parts")
    parts = M.conversations(_table(spark, sf_dir, "conversations"), max_bytes=PART_BYTES)
    requests = cut_lineage(parts.select("conv_id", "part", M.record_id().alias("record_id"), M.request_json("messages", "system").alias("body")), "parts")
    sinks.write_requests(requests, path, REQUEST_MINIMUM)
    lines = spark.read.schema("conv_id long, part long, record_id string, body string").json(path)
    request = lines.withColumn("r", F.from_json("body", M.REQUEST))
    return request.select("record_id", "conv_id", "part", "r.system", F.posexplode("r.messages").alias("pos", "m")).select(
        "record_id", "conv_id", "part", "system", F.col("pos").cast("long").alias("pos"), "m.role", "m.content"
    )


def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    copies = columns.replicate(turns, COPIES)
    return copies.withColumn("rep", F.col("rep").cast("long"))


def batch_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables give enough inputs for a batch."""
    return _union(
        [
            metrics.meets_minimum(_table(spark, sf_dir, t), M.BATCH_MINIMUM).select(
                F.lit(t).alias("table_name"), "rows", "meets_minimum"
            )
            for t in TABLES
        ]
    )


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as a search response; the other turns are plain text, so no JSON."""
    turns = _table(spark, sf_dir, "conversations")
    source = F.struct(F.col("text").alias("title"), F.col("turn").alias("turn"))
    hit = F.struct(F.col("conv_id").cast("string").alias("_id"), source.alias("_source"))
    response = F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits")))
    body = F.when(F.col("role") == "assistant", response).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", "role", body.alias("body"))


RESPONSE = "hits struct<hits:array<struct<_id:string,_source:struct<title:string,turn:long>>>>"


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir).drop("role")
    good, bad = M.parse_responses(answers, "body", RESPONSE)
    first = F.col("response.hits.hits")[0]["_source"]["title"]
    return good.select("conv_id", "turn", F.lit(True).alias("parsed"), first.alias("text")).unionByName(
        bad.select("conv_id", "turn", F.lit(False).alias("parsed"), F.col("body").alias("text"))
    )


def response_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a reason for each that is no use; turns of system have a list without hits, the
    first turn of a user's is a list."""
    empty = F.when(F.col("role") == "system", F.lit('{"hits":{"hits":[]}}'))
    listed = F.when((F.col("role") == "user") & (F.col("turn") == 0), F.lit('["text"]'))
    answers = _answers(spark, sf_dir).withColumn("body", F.coalesce(empty, listed, "body"))
    checked = M.check_responses(answers, "body", RESPONSE, ["$.hits.hits[0]._source"])
    first = F.get("response.hits.hits", F.lit(0))["_source"]["title"]
    return checked.select("conv_id", "turn", "role", "valid", "reason", F.coalesce(first, "body").alias("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_parquet,
        row_count,
        file_rows,
        file_shards,
        uri_parts,
        split_select,
        vector_scale,
        vector_scale_f32,
        map_batches_scale,
        chunk_report,
        write_roundtrip,
        shard_outputs,
        overwrite_then_append,
        incremental_events,
        row_commits,
        param_partition,
        compact_files,
        strategy_parity,
        version_latest,
        version_pinned,
        version_history,
        snapshot_export,
        tracked_dataset,
        run_log,
        conditional_column,
        drop_rename,
        argmax_label,
        upsert_by_id,
        seeded_sample,
        loader_batches,
        training_steps,
        step_numbers,
        accuracy,
        accuracy_by_class,
        dataset_profile,
        array_profile,
        fanout_distinct,
        tokenize_pad,
        token_vocab,
        token_ids,
        bm25_topk,
        benchmark_topk,
        indexed_topk,
        sparse_topk,
        reindex_scored,
        prompt_requests,
        request_parts,
        replicate_rows,
        batch_minimum,
        response_parse,
        response_check,
    )
}
