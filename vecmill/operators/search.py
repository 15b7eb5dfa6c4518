"""Top hits for text queries (BM25) and for sparse-vector queries, and re-indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vecmill.functions.text import words
from vecmill.operators.batches import map_batches
from vecmill.session import cut_lineage

# The usual BM25 parameters of a search service, and its re-index batch.
K1 = 1.2
B = 0.75
REINDEX_BATCH = 50

# Largest set of query terms, in bytes, that is broadcast; a larger one is joined by term.
BROADCAST_BYTES = 32 << 20

# Parts of scores that a task adds up at a time.
PARTS = 1 << 20


def top_hits(scores: DataFrame, id_col: str, k: int, query_col: str = "query") -> DataFrame:
    """The ``k`` best rows per query with their ``rank``; ties go to the smaller id.

    Each task cuts its rows to ``k`` per query before the shuffle, so a query that hits most
    documents costs no more than one that hits few.
    """
    best = Window.partitionBy(query_col).orderBy(F.col("score").desc(), F.col(id_col))
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def query_table(spark: SparkSession, queries: Mapping[str, str] | DataFrame) -> DataFrame:
    """``(query, text)`` of a mapping of names to query strings, or of such a table."""
    if isinstance(queries, DataFrame):
        return queries.select(F.col("query").cast("string").alias("query"), "text")
    return spark.createDataFrame(list(queries.items()), "query string, text string")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query, term, n)``: the terms of each query, by the same analyser as the documents."""
    terms = queries.select("query", F.explode(words("text")).alias("term"))
    return terms.groupBy("query", "term").agg(F.count("*").alias("n"))


def match_topk(
    docs: DataFrame, id_col: str, text_col: str, queries: Mapping[str, str] | DataFrame, k: int = 10
) -> DataFrame:
    """``(query, id_col, score, rank)`` for the ``k`` best documents of each query by BM25.

    ``queries`` maps a name to a query string, or is a table ``(query, text)`` of any number of them;
    a document that holds any of a query's terms is a hit. ``id_col`` must be unique. Documents
    without any word do not count for the corpus statistics.

    The texts are read once, unless the query terms are too large to be broadcast, when the statistics
    take a scan of their own: one pass keeps the words that any query asks for and sums up the corpus
    statistics on the way. Counts of these words per document are then joined with the queries by
    term, and the parts of a score are added in the order of the terms, so equal texts score equally.
    """
    spark = docs.sparkSession
    wanted = cut_lineage(query_terms(query_table(spark, queries)), "query-terms")
    if wanted.isEmpty():
        raise ValueError("no query holds a word")

    # Words are cut out once; no filter may follow before the counts, or it would be moved below
    # and cut them out again.
    analysed = docs.select(id_col, words(text_col).alias("_words")).withColumn("_len", F.size("_words"))
    totals = [F.count_if(F.col("_len") > 0).alias("docs"), F.sum("_len").alias("length")]
    terms = wanted.select("term").distinct()
    fits = _bytes_of(wanted) <= BROADCAST_BYTES
    seen = Observation()
    # Observed sums are exact where retried tasks count once, in the stage that writes.
    source = analysed.observe(seen, *totals) if fits else analysed
    held = source.select(id_col, "_len", F.explode("_words").alias("term"))
    found = cut_lineage(held.join(F.broadcast(terms) if fits else terms.hint("merge"), "term", "left_semi"), "hits")
    corpus = seen.get if fits else analysed.agg(*totals).first().asDict()

    n_docs = corpus["docs"]
    mean_length = (corpus["length"] or 0) / n_docs if n_docs else 1.0
    counted = cut_lineage(found.groupBy(id_col, "_len", "term").agg(F.count("*").alias("_tf")), "hit-counts")
    frequency = counted.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log(F.lit(1.0) + (F.lit(n_docs + 0.5) - F.col("_df")) / (F.col("_df") + F.lit(0.5)))
    # No larger than the query terms.
    weights = cut_lineage(wanted.join(frequency, "term").select("query", "term", (idf * F.col("n")).alias("_w")), "query-weights")

    def part(weight: Any, held: Mapping[str, Any]) -> Any:
        relative = (1.0 - B) + B * held["_len"] / mean_length
        return weight * held["_tf"] * (K1 + 1.0) / (held["_tf"] + K1 * relative)

    return top_hits(_scores(counted, id_col, ["_len", "_tf"], weights, part, fits, k), id_col, k)


def sparse_topk(
    docs: DataFrame,
    id_col: str,
    vector_col: str,
    queries: Mapping[str, Mapping[str, float]] | DataFrame,
    k: int = 10,
) -> DataFrame:
    """``(query, id_col, score, rank)`` by the dot product of term weights.

    ``vector_col`` is ``map<string, float or double>``; ``queries`` maps a name to term weights, or is
    a table ``(query, term, weight)`` of any number of them. ``id_col`` must be unique.
    """
    spark = docs.sparkSession
    if not isinstance(queries, DataFrame):
        rows = [(q, t, float(w)) for q, weights in queries.items() for t, w in weights.items()]
        queries = spark.createDataFrame(rows, "query string, term string, weight double")
    named = queries.select(F.col("query").cast("string").alias("query"), "term", F.col("weight").cast("double").alias("_w"))
    weights = cut_lineage(named, "query-weights")
    held = docs.select(id_col, F.explode(vector_col).alias("term", "_held"))
    held = held.withColumn("_held", F.col("_held").cast("double"))
    fits = _bytes_of(weights) <= BROADCAST_BYTES
    return top_hits(_scores(held, id_col, ["_held"], weights, lambda weight, held: held["_held"] * weight, fits, k), id_col, k)


def _bytes_of(rows: DataFrame) -> int:
    """Size of the strings of a table ``query, term, ...``, and of its numbers."""
    return rows.agg(F.sum(F.octet_length("query") + F.octet_length("term") + 24)).first()[0] or 0


def _scores(
    held: DataFrame,
    id_col: str,
    columns: list[str],
    weights: DataFrame,
    part: Callable[[Any, Mapping[str, Any]], Any],
    fits: bool,
    k: int,
) -> DataFrame:
    """One row per query and document with a positive score; rows come only from common terms.

    ``part`` gives what a term adds, from its weight and the ``columns`` of ``held``, as columns or as arrays.
    A small ``weights`` is held by each task, which scores its documents for all queries and passes
    on the ``k`` best of each query alone: pairs of query and document are never rows. A large one is
    joined by term, and all scores are rows.
    """
    if not fits:
        met = held.join(weights.hint("merge"), "term")
        parts = F.array_sort(F.collect_list(F.struct("term", part(F.col("_w"), {c: F.col(c) for c in columns}).alias("part"))))
        total = F.aggregate(parts, F.lit(0.0), lambda so_far, entry: so_far + entry["part"])
        return met.groupBy("query", id_col).agg(total.alias("score")).filter(F.col("score") > 0)

    wanted = Wanted.of(weights.filter("term is not null").select("query", "term", "_w").toArrow())
    spark = held.sparkSession
    codes = pa.table({"term": wanted.terms, "_code": pa.array(np.arange(len(wanted.terms)), pa.int32())})
    coded = held.join(F.broadcast(spark.createDataFrame(codes, "term string, _code int")), "term")
    # Each document is one row, dealt by its id, since a repeated id is one document.
    entries = F.collect_list(F.struct("_code", *columns)).alias("_entries")
    rows = coded.repartition(F.col(id_col)).groupBy(F.col(id_col).alias("_id")).agg(entries)
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(wanted.queries), k)
        for batch in batches:
            for docs, query, score in wanted.scores(batch.column("_entries"), columns, part, best.least):
                best.add(batch.column("_id").take(pa.array(docs)), query, score)
        found = best.rows()
        yield from pa.table([wanted.queries.take(found["query"]), found["id"], found["score"]], names=arrow.names).cast(arrow).to_batches()

    return rows.mapInArrow(run, schema)


@dataclass
class Wanted:
    """Weights by term: those of term ``i`` are ``_w[starts[i]:starts[i + 1]]``, for the queries ``query``.
    Terms are in order; ``once`` tells that no query has a term twice."""

    queries: pa.Array
    terms: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    null: np.ndarray
    once: bool

    @classmethod
    def of(cls, rows: pa.Table) -> Wanted:
        named, terms = (rows[c].combine_chunks().cast(pa.string()) for c in ("query", "term"))
        coded = named.dictionary_encode(null_encoding="encode")
        term = terms.dictionary_encode()
        in_order = pc.sort_indices(term.dictionary).to_numpy()
        place = np.empty(len(in_order), np.int64)
        place[in_order] = np.arange(len(in_order))
        code, query = place[term.indices.to_numpy()], coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((query, code))
        code, query = code[order], query[order]
        once = not ((code[1:] == code[:-1]) & (query[1:] == query[:-1])).any()
        weight = rows["_w"].combine_chunks()
        return cls(
            coded.dictionary, term.dictionary.take(pa.array(in_order)), np.searchsorted(code, np.arange(len(in_order) + 1)), query,
            weight.to_numpy(zero_copy_only=False)[order], weight.is_null().to_numpy(zero_copy_only=False)[order], once,
        )

    def scores(
        self, lists: pa.Array, columns: list[str], part: Callable, least: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, query and score of the rows whose score is positive and at least that of ``least``."""
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        code = flat.field("_code").to_numpy().astype(np.int64)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        held = {c: flat.field(c).to_numpy(zero_copy_only=False)[order] for c in columns}
        null = np.zeros(len(doc), bool)
        for c in columns:
            null |= flat.field(c).is_null().to_numpy(zero_copy_only=False)[order]
        once = self.once and not ((doc[1:] == doc[:-1]) & (code[1:] == code[:-1])).any()
        count, many = self.starts[code + 1] - self.starts[code], len(self.queries)
        ends = np.cumsum(np.bincount(doc, count, len(lists)).astype(np.int64))
        entry, first = np.searchsorted(doc, np.arange(len(lists) + 1)), 0
        while first < len(lists):
            # As many documents as give a bounded number of parts, and one at least.
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + PARTS, "right")))
            own = slice(entry[first], entry[last])
            times = count[own]
            at = np.repeat(np.arange(own.start, own.stop), times)
            weight = np.arange(len(at)) + np.repeat(self.starts[code[own]] - np.cumsum(times) + times, times)
            key = (doc[at] - first) * many + self.query[weight]
            value = part(self.weight[weight], {c: v[at] for c, v in held.items()})
            missing = null[at] | self.null[weight]
            if not once:
                by = np.lexsort((value, code[at], key))
                key, value, missing = key[by], value[by], missing[by]
            cells = np.arange((last - first) * many) if (last - first) * many <= 8 * len(key) else np.unique(key)
            if len(cells) < (last - first) * many:
                key = np.searchsorted(cells, key)
            # In the order of the terms, so that equal texts score equally.
            total = np.bincount(key, value, len(cells))
            good = np.isnan(total) | ((total > 0) & (total >= least[cells % many]))
            if missing.any():
                good &= np.bincount(key, missing, len(cells)) == 0
            cells, total = cells[good], total[good]
            yield cells // many + first, cells % many, total
            first = last


class Best:
    """The ``k`` best rows of each query so far, as ``top_hits`` orders them."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.bound = k, np.full(queries, -np.inf), max(4 * k * queries, 1 << 16)
        self.parts: list[pa.Table] = []
        self.held = 0

    def add(self, ids: pa.Array, query: np.ndarray, score: np.ndarray) -> None:
        self.parts.append(pa.table({"query": pa.array(query), "id": ids, "score": pa.array(score)}))
        self.held += len(ids)
        if self.held > self.bound or len(self.parts) > 1 << 10:
            self.parts = [self.rows()]
            self.held = self.parts[0].num_rows

    def rows(self) -> pa.Table:
        if not self.parts:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.nulls(0), "score": pa.array([], pa.float64())})
        rows = pa.concat_tables(self.parts).combine_chunks()
        # Nulls and what is no number come first, as in a descending order of Spark.
        order = pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        query, score = rows["query"].to_numpy(), rows["score"].to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
        return rows.filter(pa.array(rank < self.k))


def reindex(
    docs: DataFrame,
    scorer: Callable[[Any], Any],
    schema: str | None = None,
    batch_size: int = REINDEX_BATCH,
) -> DataFrame:
    """Run every document through ``scorer`` (an Arrow batch function that appends its output
    field, such as model weights), ``batch_size`` documents at a time; write the result with any
    sink. The scorer belongs to the caller."""
    return map_batches(docs, scorer, batch_size=batch_size, schema=schema)
