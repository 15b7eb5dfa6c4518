"""A stored inverted index with a bound for each block, and top-k search that skips blocks.

Four tables below one path, all written once and read by any number of searches:

- ``forward``: ``(id, len, terms)``, the counted words of each document;
- ``blocks``: ``(term, level, draw, bound, ids, impacts)``, at most ``BLOCK`` postings of a term in a segment, those
  of the highest impact first. The impact is what BM25 gives for a posting without the weight of its
  term, rounded up to single precision; ``bound`` is the block's highest, ``level`` its whole number
  of ``1 / LEVELS``;
- ``lexicon``: ``(term, level, n, bound)``, how many postings a term has in blocks of a level, and the
  highest bound of these;
- ``corpus``: one row, ``(docs, length)``.

A segment is a run of documents with ``SEGMENT`` postings that one task reads, so blocks are made without
moving a row, and a term that nearly every document holds is no large group anywhere. ``draw`` is a
number from 0 to 1 for each segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vecmill.functions.text import words
from vecmill.operators.batches import map_batches, release_memory
from vecmill.operators.search import B, BROADCAST_BYTES, K1, query_table, query_terms, top_hits
from vecmill.session import cut_lineage

BLOCK = 64
SEGMENT = 1 << 21
# What a task counts or weighs at a time, and bytes of the batches that it is given, whatever the table.
COUNTED_WORDS = 1 << 17
BATCH_BYTES = 8 << 20
# Levels for each unit of impact; impacts lie between 0 and K1 + 1.
LEVELS = 16
# Postings of a query that are read, and documents of it that are scored, for its first threshold.
SEED_POSTINGS = 10_000
SEED_DOCS = 40
# Query terms that are named in the filter of a scan, so that Parquet skips row groups without them.
NAMED_TERMS = 256
# What all unread postings of a query may add up to, as a share of its threshold: the less, the more
# postings are read and the fewer documents stay open.
OPEN_SHARE = 0.5
# Bounds and scores are sums in different orders, so a bound counts as reached a little earlier.
SLACK = 1.0 - 1e-9
ENTRIES = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))


def _counted(batch: pa.Table) -> pa.Table:
    """Each document's words once, with their count, in the order of the words."""
    lists = batch["_words"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    parts, begin = [], 0
    while begin < len(lists):
        # Some documents at a time, one at least, so that memory does not grow with the batch.
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + COUNTED_WORDS, "right")))
        parts.append(_counted_lists(lists.slice(begin, end - begin)))
        begin = end
    terms = pa.chunked_array(parts, ENTRIES)
    return batch.drop_columns("_words").append_column("terms", terms)


def _counted_lists(lists: pa.Array) -> pa.Array:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    placed = pa.table({"doc": np.repeat(np.arange(len(lists)), lengths), "term": lists.flatten()})
    counts = placed.group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    counts = counts.sort_by([("doc", "ascending"), ("term", "ascending")])
    offsets = np.searchsorted(counts["doc"].to_numpy(), np.arange(len(lists) + 1)).astype(np.int32)
    entries = pa.StructArray.from_arrays([counts["term"].combine_chunks(), counts["count_all"].combine_chunks().cast(pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents in pieces of about ``SEGMENT`` postings; a piece has one document at least."""
    held, postings = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SEGMENT - postings, "right")))
            held.append(batch.slice(begin, end - begin))
            postings += int(ends[end - 1] - before)
            begin = end
            if postings >= SEGMENT or begin < len(ends):
                yield pa.Table.from_batches(held)
                held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _cut_blocks(segment: pa.Table, mean_length: float) -> pa.Table:
    """The blocks of one segment, in the order of their terms."""
    lists = segment["terms"].combine_chunks()
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    entries = lists.flatten()
    frequency, relative = entries.field("tf").to_numpy(), (1.0 - B) + B * segment["len"].to_numpy() / mean_length
    single = np.empty(len(doc), np.float32)
    # Double precision for some postings at a time.
    for begin in range(0, len(doc), COUNTED_WORDS):
        own = slice(begin, begin + COUNTED_WORDS)
        tf = frequency[own].astype(np.float64)
        impact = tf * (K1 + 1.0) / (tf + K1 * relative[doc[own]])
        near = impact.astype(np.float32)
        single[own] = np.where(near < impact, np.nextafter(near, np.float32(np.inf)), near)

    encoded = entries.field("term").dictionary_encode()
    del lists, entries, frequency
    by_name = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int32)
    place[by_name] = np.arange(len(by_name), dtype=np.int32)
    term = place[encoded.indices.to_numpy()]
    # Documents are in order already, and the orders are stable.
    order = np.argsort(-single, kind="stable").astype(np.int32)
    order = order[np.argsort(term[order], kind="stable")]
    term, single = term[order], single[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.diff(np.r_[first, len(term)])
    blocks = -(-sizes // BLOCK)
    starts = np.repeat(first - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(blocks.sum())
    offsets = pa.array(np.r_[starts, len(term)].astype(np.int32))
    bound = single[starts].astype(np.float64)
    ids = segment["id"].combine_chunks().take(pa.array(doc[order]))
    draw = zlib.crc32(str(segment["id"][0]).encode()) / 2.0**32
    return pa.table(
        {
            "term": encoded.dictionary.take(pa.array(by_name[term[starts]])),
            "level": pa.array(np.floor(bound * LEVELS).astype(np.int32)),
            "draw": pa.array(np.full(len(starts), draw)),
            "bound": pa.array(bound),
            "ids": pa.ListArray.from_arrays(offsets, ids),
            "impacts": pa.ListArray.from_arrays(offsets, pa.array(single)),
        }
    )


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Write the index of ``docs`` below ``path``, which must not exist.

    ``id_col`` must be unique and not null. Documents without a word are not in it and do not count
    for the corpus statistics. The texts are read once and no row of theirs is shuffled; only the
    lexicon, one row per term, level and task, is.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    analysed = docs.select(F.col(id_col).alias("id"), words(text_col).alias("_words")).withColumn("len", F.size("_words"))
    held = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
    key = analysed.schema["id"]
    schema = T.StructType([key, T.StructField("len", T.IntegerType()), T.StructField("terms", held)])
    seen = Observation()
    forward = map_batches(analysed.filter("len > 0"), _counted, schema=schema)
    forward.observe(seen, F.count("*").alias("docs"), F.sum("len").alias("length")).write.parquet(f"{path}/forward")
    n_docs, length = seen.get["docs"], seen.get["length"] or 0
    spark.range(0, 1, 1, 1).select(
        F.lit(n_docs).cast("long").alias("docs"), F.lit(length).cast("long").alias("length")
    ).write.parquet(f"{path}/corpus")

    mean_length = length / n_docs if n_docs else 1.0
    shape = T.StructType.fromDDL("term string, level int, draw double, bound double")
    shape = shape.add("ids", T.ArrayType(key.dataType)).add("impacts", T.ArrayType(T.FloatType()))
    arrow = to_arrow_schema(shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            yield from _cut_blocks(segment, mean_length).cast(arrow).to_batches(max_chunksize=8192)
            del segment
            release_memory()

    # By term within each segment, so that row groups can be told apart by their terms.
    spark.read.schema(schema).parquet(f"{path}/forward").mapInArrow(cut, shape).write.parquet(f"{path}/blocks")
    written = spark.read.schema(shape).parquet(f"{path}/blocks").groupBy("term", "level")
    lexicon = written.agg(F.sum(F.size("ids")).cast("long").alias("n"), F.max("bound").alias("bound"))
    lexicon.sortWithinPartitions("term").write.parquet(f"{path}/lexicon")


def index_topk(spark: SparkSession, path: str, queries: Mapping[str, str] | DataFrame, k: int = 10, id_col: str = "id") -> DataFrame:
    """``(query, id_col, score, rank)`` as ``match_topk`` gives it, from the index below ``path``.

    1. Some postings of each query (of its rarest terms and highest impacts first) name documents that
       are scored in full; the k-th best of these scores is a threshold that the result cannot be below.
    2. From the lexicon, levels are chosen, those that lower the bound most for a posting first, until
       what all unread postings of a query can add up to is below ``OPEN_SHARE`` of its threshold. A document that is
       only in unread blocks cannot be among the best, so these blocks are skipped.
    3. Documents of the blocks read are kept if what was read and the bounds of the rest reach the
       threshold. Only these are scored in full, by their forward entries.

    Nothing is left out that could be a hit: a query with fewer than ``k`` hits has the threshold 0 and
    all its postings are read. Ties go to the smaller id. Empty tables have no hits.
    """
    wanted = cut_lineage(query_terms(query_table(spark, queries)), "query-terms")
    if wanted.isEmpty():
        raise ValueError("no query holds a word")
    corpus = spark.read.parquet(f"{path}/corpus").first()
    n_docs = corpus["docs"]
    mean_length = corpus["length"] / n_docs if n_docs else 1.0

    found = _of_terms(spark.read.parquet(f"{path}/lexicon"), wanted)
    frequency = Window.partitionBy("query", "term")
    idf = F.log(F.lit(1.0) + (F.lit(n_docs + 0.5) - F.col("_df")) / (F.col("_df") + F.lit(0.5)))
    # One row per query, term and level: no more than the query terms times the levels.
    levels = cut_lineage(
        found.withColumnRenamed("n_lexicon", "n")
        .withColumn("_df", F.sum("n").over(frequency))
        .select("query", "term", "level", "n", (idf * F.col("times")).alias("_w"), "bound"),
        "query-levels",
    )
    weights = levels.select("query", "term", "_w").distinct()

    gain = F.col("_w") * F.col("bound")
    first = Window.partitionBy("query").orderBy(gain.desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = levels.withColumn("_before", F.coalesce(F.sum("n").over(first), F.lit(0))).filter(F.col("_before") < SEED_POSTINGS)
    # Of a long level only some segments; any choice of postings gives a valid threshold.
    named = _blocks(spark, path, seeds.select("query", "term", "level", "_w", "n")).filter(F.col("draw") * F.col("n") < SEED_POSTINGS)
    seen = _postings(named).groupBy("query", "id").agg(F.sum(F.col("_w") * F.col("_impact")).alias("score"))
    some = top_hits(seen, "id", SEED_DOCS + k).select("query", "id")
    scored = top_hits(_scores(spark, path, cut_lineage(some, "query-seeds"), weights, mean_length), "id", k)
    threshold = scored.filter(F.col("rank") == k).select("query", (F.col("score") * SLACK).alias("_least"))

    down = Window.partitionBy("query", "term").orderBy(F.desc("level"))
    lower = F.coalesce(F.lead("bound").over(down), F.lit(0.0))
    steps = (
        levels.withColumn("_gain", F.col("_w") * (F.col("bound") - lower))
        .withColumn("_left", F.col("_w") * lower)
        .withColumn("_worth", F.min(F.col("_gain") / F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .join(threshold, "query", "left")
    )
    order = Window.partitionBy("query").orderBy(F.desc("_worth"), "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_gain").over(Window.partitionBy("query"))
    unread = total - F.coalesce(F.sum("_gain").over(order), F.lit(0.0))
    # The sums round, so what remains of them is compared with a little room.
    chosen = steps.withColumn("_read", unread >= F.coalesce("_least", F.lit(0.0)) * OPEN_SHARE - total * (1.0 - SLACK))
    # What an unread posting of a term can still be worth, by term and in all.
    rest = F.coalesce(F.min(F.when(F.col("_read"), F.col("_left"))).over(frequency), F.max(gain).over(frequency))
    depth = cut_lineage(
        chosen.withColumn("_rest", rest).select("query", "term", "level", "_w", "_read", "_rest", "_least", "n"), "query-depths"
    )
    open_bound = depth.select("query", "term", "_rest", "_least").distinct().groupBy("query").agg(
        F.sum("_rest").alias("_open"), F.coalesce(F.first("_least"), F.lit(0.0)).alias("_least")
    )
    read = _blocks(spark, path, depth.filter("_read").select("query", "term", "level", "_w", "_rest"))
    bounds = _postings(read, "_rest").groupBy("query", "id").agg(F.sum(F.col("_w") * F.col("_impact") - F.col("_rest")).alias("_sum"))
    # One row per query on the right.
    near = bounds.join(open_bound, "query").filter((F.col("_sum") + F.col("_open")) >= F.col("_least") * SLACK - F.col("_open") * (1.0 - SLACK))
    candidates = cut_lineage(near.select("query", "id"), "query-candidates")
    hits = top_hits(_scores(spark, path, candidates, weights, mean_length), "id", k)
    return hits.withColumnRenamed("id", id_col)


def _named(scan: DataFrame, terms: DataFrame) -> DataFrame:
    """``scan`` with a filter that Parquet can use, when only a few terms are asked for."""
    few = [r["term"] for r in terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    return scan.filter(F.col("term").isin(few)) if len(few) <= NAMED_TERMS else scan


def _fits(rows: DataFrame) -> bool:
    """Are the rows of a query table small enough to be broadcast?"""
    return (rows.agg(F.sum(F.octet_length("query") + 64)).first()[0] or 0) <= BROADCAST_BYTES


def _of_terms(lexicon: DataFrame, wanted: DataFrame) -> DataFrame:
    asked = wanted.withColumnRenamed("n", "times")
    side = F.broadcast(asked) if _fits(wanted) else asked.hint("merge")
    return _named(lexicon, wanted).withColumnRenamed("n", "n_lexicon").join(side, "term")


def _blocks(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The blocks on the levels that are ``asked`` for, once for each query that asks."""
    fixed = cut_lineage(asked, "query-blocks")
    side = F.broadcast(fixed) if _fits(fixed) else fixed.hint("merge")
    return _named(spark.read.parquet(f"{path}/blocks"), fixed).join(side, ["term", "level"])


def _postings(blocks: DataFrame, *columns: str) -> DataFrame:
    return blocks.select("query", "_w", *columns, F.inline(F.arrays_zip("ids", "impacts"))).withColumnsRenamed({"ids": "id", "impacts": "_impact"})


def _scores(spark: SparkSession, path: str, pairs: DataFrame, weights: DataFrame, mean_length: float) -> DataFrame:
    """Scores of pairs of query and document by all terms that they share, added in their order."""
    fits = _fits(pairs)
    named = F.broadcast(pairs) if fits else pairs.hint("merge")
    entries = spark.read.parquet(f"{path}/forward").join(named, "id").select("query", "id", "len", F.inline("terms"))
    fixed = F.broadcast(weights) if _fits(weights) else weights.hint("merge")
    relative = F.lit(1.0 - B) + F.lit(B) * F.col("len") / F.lit(mean_length)
    part = F.col("_w") * F.col("tf") * F.lit(K1 + 1.0) / (F.col("tf") + F.lit(K1) * relative)
    parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda so_far, entry: so_far + entry["part"])
    return entries.join(fixed, ["query", "term"]).groupBy("query", "id").agg(total.alias("score"))
