"""MinHash near-duplicates from bottom-k sketches of one hash function (operator 3).

Every document keeps the k smallest hashes of its shingles. Two sets with a Jaccard similarity of t
share about ``t * k`` of the k smallest hashes of their union, and each of those is in both sketches;
with k = 64 and t = 0.75 they share fewer than 28 with a probability of 4e-7. So a document needs
inverted lists only for its ``k - 28 + 1`` rarest retained values: two documents that share 28 values
share one of these. Values that only one document retains come first among the rarest, and most
documents have so many of them that no list is left; frequent passages never make lists.

Documents with equal sets are one class from the start. In every list each document first meets the
list's first document; of these partners each document takes the one with most lists in common.
Confirmed links are joined to components, and only pairs of a list that are still in different
components are enumerated; the estimate from the union of their sketches filters them, and the full
sets decide. So large groups of near copies cost as many comparisons as they have documents.

A list in which such pairs would be many (a passage that makes up half of many short documents) is
not enumerated. Its documents get lists anew from their full sets: similar sets share one of the
rarest quarter of each, without an error, and a passage is not in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import LOWER_ASCII, bound_batches, buffers, encoded, id_text, slices, strings, task_memory, words
from vecmill.llm.components import components
from vecmill.llm.labelled import MULTIPLIER, hashes
from vecmill.session import cut_lineage

SHINGLE = 5
PERCENT = 75
K = 64
SHARED = 28
# Members of one hub that a task compares, and bits of the filter of wanted documents.
CHUNK = 256
FILTER_WORDS = 1 << 20
# Pairs in different components for each member, above which full sets take over from a list.
DENSE = 4
# Bits that bound what two full sets have in common.
BITMAP = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted 63-bit hashes of each text's distinct shingles."""
    body, bounds, by_text = words(data, offsets)
    mixed = np.zeros(0, np.uint64)
    if len(bounds) > 1:
        codes, distinct = encoded(strings(LOWER_ASCII[body], bounds))
        word = hashes(distinct)[codes]
        if len(word) >= SHINGLE:
            count = len(word) - SHINGLE + 1
            mixed = word[:count].copy()
            for step in range(1, SHINGLE):
                mixed = mixed * MULTIPLIER + word[step : step + count]
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed = (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)
    for first, last in zip(by_text[:-1].tolist(), by_text[1:].tolist()):
        if last - first >= SHINGLE:
            yield np.unique(mixed[first : last - SHINGLE + 1])
        elif last > first:
            whole = np.uint64(last - first)
            for value in word[first:last]:
                whole = np.uint64((int(whole) * int(MULTIPLIER) + int(value)) % (1 << 64))
            whole = int(whole) * 0x94D049BB133111EB % (1 << 64)
            yield np.array([(whole ^ (whole >> 29)) >> 1], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _mark(values: np.ndarray, salt: int) -> int:
    """A 63-bit fingerprint of a set, whatever its order."""
    mixed = (values ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    return int((mixed * np.uint64(0xC4CEB9FE1A85EC53)).sum(dtype=np.uint64) >> np.uint64(1))


def sketches(source: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, mark1, mark2, sketch`` of every row; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, offsets = buffers(batch.column("text"))
                rows = []
                for a, b in slices(offsets):
                    for values in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        rows.append((len(values), _mark(values, 1), _mark(values, 2), values[:k].astype(np.int64)))
                sizes, first, second, lists = zip(*rows)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
                columns = [batch.column("doc_id"), pa.array(sizes), pa.array(first), pa.array(second), flat]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "mark1", "mark2", "sketch"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, mark1 long, mark2 long, sketch array<long>")


def id_filter(wanted: DataFrame) -> np.ndarray:
    """A filter of ids, ``FILTER_WORDS`` words of 64 bits whatever their number."""
    word = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS)).alias("word")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(7, doc_id), 64) as int))")
    found = wanted.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _wanted(source: DataFrame, route: DataFrame) -> DataFrame:
    """The documents whose ids are in ``route``, and a few more that the filter lets through."""
    bits = id_filter(route)
    marked = source.select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS)).alias("word"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(64)).alias("bit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                keep = (bits[batch.column("word").to_numpy()] >> batch.column("bit").to_numpy()) & 1
                yield batch.select(["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

    kind = source.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, text string")


def verify(source: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``hub, doc_id`` whose full sets are similar enough.

    A hub's text is sent to each task that compares some of its members with it; members come one
    after the other, so a hub with any number of them is never held in one task.
    """
    pairs = cut_lineage(pairs, "pairs")
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    members = pairs.join(hubs, "hub").select(
        "doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("chunk"), F.lit(1).alias("role")
    )
    leaders = hubs.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    route = cut_lineage(members.unionByName(leaders), "routes")
    moved = _wanted(source, route).join(route, "doc_id").select("hub", "chunk", "role", "doc_id", "text")
    count = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = moved.repartition(count, "hub", "chunk").sortWithinPartitions("hub", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            hub, full = None, None
            for batch in batches:
                found = []
                hubs, roles, ids = (batch.column(c).to_pylist() for c in ("hub", "role", "doc_id"))
                data, offsets = buffers(batch.column("text"))
                row = 0
                for a, b in slices(offsets):
                    for values in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        if roles[row] == 0:
                            hub, full = hubs[row], values
                        elif hub == hubs[row]:
                            small = min(len(full), len(values))
                            if 100 * small >= percent * max(len(full), len(values)):
                                both = len(np.intersect1d(full, values, assume_unique=True))
                                if 100 * both >= percent * (len(full) + len(values) - both):
                                    found.append((hub, ids[row]))
                        row += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["hub", "doc_id"])

    return dealt.mapInArrow(run, "hub long, doc_id long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = K, shared: int = SHARED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are runs without white space, A-Z in lower case; a text with fewer than five words is one
    shingle, one without words, or null, is empty and linked with nothing. ``component_id`` is the
    smallest id reachable over links of at least ``percent`` per cent similarity. Rows without an id
    come back unlinked. Repeated rows count as rows of one id. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    source = id_text(docs, id_col, text_col)
    table = cut_lineage(sketches(source, k), "sketches")
    real = table.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(real.groupBy("mark1", "mark2").agg(F.min("doc_id").alias("class_id")), "set-classes")
    leaders = real.join(classes.select(F.col("class_id").alias("doc_id"), "mark1", "mark2"), ["doc_id", "mark1", "mark2"])
    values = leaders.select("doc_id", "n_shingles", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    lists = cut_lineage(_lists(values.join(often, "value"), shared, k, False), "lists")

    first = lists.groupBy("value").agg(F.min("doc_id").alias("hub"), F.count("*").alias("f")).where("f > 1").drop("f")
    met = lists.join(first, "value").where("hub < doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("hub")).alias("h"))).alias("b"))
    links = cut_lineage(verify(source, best.select((-F.col("b.h")).alias("hub"), "doc_id"), percent), "set-links")
    known = components(links, "hub", "doc_id")

    placed = cut_lineage(_placed(lists, known), "placed")
    parts = placed.groupBy("value", "component").agg(F.count("*").alias("c"))
    counts = parts.groupBy("value").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    counts = counts.withColumn("apart", (F.col("m") * F.col("m") - F.col("squares")) / 2).where("apart > 0")
    thin = placed.join(counts.where(F.col("apart") <= DENSE * F.col("m")).select("value"), "value")
    dense = placed.join(counts.where(F.col("apart") > DENSE * F.col("m")).select("value"), "value")
    dense = cut_lineage(dense.select("doc_id", "n_shingles").distinct(), "dense")
    full = cut_lineage(_full_values(source, dense), "full-values")
    often = full.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    deep = cut_lineage(_placed(_lists(full.join(often, "value"), percent, 100, True), known), "placed")
    rest = cut_lineage(_apart(thin, percent, False).unionByName(_apart(deep, percent, True)).distinct(), "pairs")
    likely = _estimated(rest, leaders.select("doc_id", "sketch"), k, shared)
    more = verify(source, likely, percent)
    roots = components(links.unionByName(cut_lineage(more, "set-links")), "hub", "doc_id")
    grouped = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "mark1", "mark2", F.coalesce("component", "class_id").alias("component_id")
    )
    marked = table.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(m)).alias(m) for m in ("mark1", "mark2")])
    joined = marked.join(grouped, ["mark1", "mark2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _lists(shared_values: DataFrame, part: int, whole: int, full: bool) -> DataFrame:
    """Inverted lists ``value, doc_id, n_shingles``: of each sketch the rarest values, as many as
    leave fewer than the needed number (``part / whole`` of the values) out.

    Lists of full sets also have ``held``, the number of a set's values that another document has;
    ``bits``, a bitmap of these; and ``before``, the rarer values of the same document in lists.
    """
    need = F.ceil(F.col("size") * part / whole)
    bit = F.expr(f"shiftleft(1L, cast(pmod(value, {BITMAP}) % 64 as int))")
    bits = [F.bit_or(F.when(F.floor(F.pmod("value", F.lit(BITMAP)) / 64) == j, bit).otherwise(0)).alias(f"bits{j}") for j in range(BITMAP // 64)]
    own = F.array_sort(F.collect_list(F.struct("f", "value"))).alias("own")
    gathered = shared_values.groupBy("doc_id", "n_shingles", "size").agg(own, *(bits if full else []))
    # Values of one document alone are rarer than all of these.
    left = (F.col("size") - need + 1 - (F.col("size") - F.size("own"))).cast("int")
    more = [F.size("own").alias("held"), *[f"bits{j}" for j in range(BITMAP // 64)]] if full else []
    kept = gathered.where(left > 0).select("doc_id", "n_shingles", *more, "own", F.posexplode(F.slice("own", 1, left)).alias("pos", "v"))
    before = [F.slice(F.col("own")["value"], F.lit(1), F.col("pos")).alias("before")] if full else []
    names = [m if isinstance(m, str) else "held" for m in more]
    return kept.select("doc_id", "n_shingles", *names, *before, F.col("v.value").alias("value"))


def _placed(lists: DataFrame, known: DataFrame) -> DataFrame:
    joined = lists.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def _full_values(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, size, value`` for every shingle of the wanted documents."""
    moved = _wanted(source, wanted).join(wanted, "doc_id").select("doc_id", "text").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            for batch in batches:
                data, offsets = buffers(batch.column("text"))
                ids = batch.column("doc_id").to_numpy()
                for a, b in slices(offsets):
                    sets = list(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    sizes = np.array([len(x) for x in sets])
                    columns = [np.repeat(ids[a:b], sizes), np.repeat(sizes, sizes), np.concatenate(sets).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n_shingles", "value"])

    return moved.mapInArrow(run, "doc_id long, n_shingles long, value long").withColumn("size", F.col("n_shingles"))


def _apart(placed: DataFrame, percent: int, full: bool) -> DataFrame:
    """Pairs of a list in different components whose sizes allow a link.

    For full sets each pair comes from its first common list only, and what the two can have in common
    is bounded: values behind a bit that only one of them has are not common.
    """
    sizes = placed.groupBy("value", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("value").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"))
    largest = largest.where("parts > 1").select("value", F.col("top.component").alias("main"))
    placed = cut_lineage(placed.join(largest, "value").withColumn("main", F.col("component") == F.col("main")), "mixed")
    rest = [c for c in placed.columns if c not in ("value", "doc_id")]
    # Members of a list's largest component meet only the others, never each other.
    a = placed.where("not main").select("value", F.col("doc_id").alias("hub"), *[F.col(c).alias(f"{c}_a") for c in rest])
    b = placed.select("value", "doc_id", *[F.col(c).alias(f"{c}_b") for c in rest])
    both = F.col("n_shingles_a") + F.col("n_shingles_b")
    fits = (F.col("component_a") != F.col("component_b")) & (F.col("main_b") | (F.col("hub") < F.col("doc_id")))
    fits &= 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    if full:
        for x, y in ("ab", "ba"):
            alone = sum(F.bit_count(F.col(f"bits{j}_{x}").bitwiseAND(F.bitwise_not(F.col(f"bits{j}_{y}")))) for j in range(BITMAP // 64))
            fits &= (100 + percent) * (F.col(f"held_{x}") - alone) >= percent * both
        fits &= ~F.arrays_overlap("before_a", "before_b")
    pairs = a.join(b, "value").where(fits)
    return pairs.select(F.least("hub", "doc_id").alias("hub"), F.greatest("hub", "doc_id").alias("doc_id")).distinct()


def _estimated(pairs: DataFrame, known: DataFrame, k: int, shared: int) -> DataFrame:
    """Pairs whose similarity, estimated on the k smallest hashes of both sets, may be enough."""
    a = known.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("s"))
    b = known.select("doc_id", F.col("sketch").alias("t"))
    union = F.slice(F.array_sort(F.array_union("s", "t")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("s", "t")))
    return pairs.join(a, "hub").join(b, "doc_id").where(common * k >= F.size(union) * shared).select("hub", "doc_id")
