"""Repeated passages by super-k-mer partitioning (operator 12).

A window is 20 consecutive words. Its minimiser is the smallest hash of the rows of three words in it,
so equal windows have equal minimisers wherever they stand, and neighbouring windows mostly share
theirs. Windows in a row that share a minimiser travel as one packed string, a super-k-mer, to the
bucket of the minimiser; there all windows of different super-k-mers are sorted and compared word by
word. Super-k-mers that only one document holds, in a bucket of their own, are done at once.

Copies are combined before the shuffle, and again while a bucket is read, so a bucket holds different
strings only. The super-k-mers that a task sends to one partition travel as one pressed row: each word
stands in about three of them, and Spark's own compression of rows cannot use that they are sorted. A super-k-mer carries the smallest id that holds it: every other document loses all its
windows, and only that document asks the bucket which of them start earlier elsewhere. What a bucket
says is met with the places of the super-k-mers by their 128-bit digests; the few digests with more
than their share of the places are met by a broadcast of bounded size. A bucket of more than
``BUCKET_BYTES`` different strings is not held: its windows are sent one by one, by their own digests.
Windows that repeat within one document are found where the document is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import BATCH_BYTES, bound_batches, buffers, encoded, map_arrow, slices, spread_ranges, strings, words
from vecmill.llm.labelled import MULTIPLIER, hashes
from vecmill.llm.periodic import join_words
from vecmill.session import cut_lineage

WINDOW = 20
SEED_WORDS = 3
# Bytes of super-k-mers that a task combines before it passes them on, and that a bucket may hold.
COMBINE_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 1 << 14
PRESSED = "partition int, size long, pressed binary"
# Digests with more than this share of all places are met by broadcast: there are at most as many.
HOT = 4096
NO_ID = (1 << 63) - 1


def _finish(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(32))


def _rows(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on, as far as there are so many."""
    count = max(len(hashed) - size + 1, 0)
    mixed = np.full(count, np.uint64(size))
    for step in range(size):
        mixed = mixed * MULTIPLIER + hashed[step : step + count]
    return _finish(mixed)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of ``size`` values from each place on."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def super_kmers(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The super-k-mers of the texts: packed words, minimiser, text, first word in the text, and number
    of windows."""
    body, bounds, by_text = words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(bounds) <= WINDOW:
        return [], none, none, none, none
    codes, distinct = encoded(strings(body, bounds))
    seeds = _rows(hashes(distinct)[codes], SEED_WORDS)
    least = _least(seeds, WINDOW - SEED_WORDS + 1)
    counts = np.maximum(np.diff(by_text) - WINDOW + 1, 0)
    at = spread_ranges(by_text[:-1], counts)
    if not len(at):
        return [], none, none, none, none
    key = least[at]
    head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)))
    size = np.diff(np.append(head, len(at)))
    first = at[head]
    text = np.searchsorted(by_text, first, "right") - 1
    # One blank after each word.
    spaced = np.full(len(body) + len(codes), ord(" "), np.uint8)
    spaced[np.arange(len(body)) + np.repeat(np.arange(len(codes)), np.diff(bounds))] = body
    raw = spaced.tobytes()
    begin = bounds[first] + first
    last = first + size + WINDOW - 1
    end = bounds[last] + last - 1
    packed = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    return packed, key[head].view(np.int64), text, first - by_text[text], size


def digests(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digests of byte strings, as two signed numbers each."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def earlier(codes: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each window, whether an equal window of its group has a smaller rank. Windows are sorted by
    a hash; those that meet are compared word by word."""
    found = np.zeros(len(at), bool)
    if len(at) < 2:
        return found
    mark = _rows(codes.astype(np.uint64), WINDOW)[at] ^ _finish(group.astype(np.uint64) * MULTIPLIER)
    order = np.lexsort((rank, mark))
    same = mark[order][1:] == mark[order][:-1]
    inside = np.append(False, same) | np.append(same, False)
    order = order[inside]
    if not len(order):
        return found
    head = np.append(True, mark[order][1:] != mark[order][:-1])
    leader = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    equal = group[order] == group[leader]
    for step in range(WINDOW):
        equal &= codes[at[order] + step] == codes[at[leader] + step]
    found[order] = equal & (rank[order] > rank[leader])
    if not equal.all():
        # Different windows under one hash: each is compared with all equal ones.
        own = order[np.isin(mark[order], mark[order[~equal]])].tolist()
        spelled = {i: (int(group[i]), codes[at[i] : at[i] + WINDOW].tobytes()) for i in own}
        lowest: dict = {}
        for i in own:
            lowest[spelled[i]] = min(lowest.get(spelled[i], rank[i]), rank[i])
        for i in own:
            found[i] = rank[i] > lowest[spelled[i]]
    return found


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, an order of ids in which null is last, texts, and a mark that tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(F.col(id_col).alias("doc_id"), own.alias("own"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _combined(source: DataFrame) -> DataFrame:
    """``minimiser, packed, least, several, more``: the super-k-mers of each task, those of a minimiser in one
    partition. Equal ones of a task are combined: the smallest id, whether there are others, and how many more
    places there are."""

    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(seen: dict[bytes, int], columns: tuple[list, ...]) -> Iterator[pa.RecordBatch]:
        keys, least, several, more = columns
        table = pa.table([pa.array(keys, pa.int64()), pa.array(list(seen), pa.binary()), pa.array(least, pa.int64()), pa.array(several, pa.bool_()), pa.array(more, pa.int64())], PACKED)
        yield from press(table, partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, columns, held = {}, ([], [], [], []), 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("own").to_numpy()
            for a, b in slices(offsets):
                packed, key, text, _, _ = super_kmers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys, least, several, more = columns
                for one, minimiser, own in zip(packed, key.tolist(), ids[a + text].tolist()):
                    if (i := seen.get(one)) is None:
                        seen[one] = len(keys)
                        keys.append(minimiser)
                        least.append(own)
                        several.append(False)
                        more.append(0)
                        held += len(one)
                    else:
                        several[i] |= least[i] != own
                        least[i], more[i] = min(least[i], own), more[i] + 1
                if held > COMBINE_BYTES:
                    yield from emit(seen, columns)
                    seen, columns, held = {}, ([], [], [], []), 0
        yield from emit(seen, columns)

    bound_batches(source.sparkSession)
    pressed = source.select("own", "text").mapInArrow(run, PRESSED).repartitionById(partitions, "partition")
    return pressed.mapInArrow(lambda batches: (part for batch in batches for part in unpress(batch)), "minimiser long, packed binary, least long, several boolean, more long")


PACKED = ["minimiser", "packed", "least", "several", "more"]
ANSWER = "d1 long, d2 long, least long, several boolean, places long, repeated array<int>, packed binary"


def press(table: pa.Table, partitions: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PRESSED``: the super-k-mers of each partition in the order of their minimisers, at most
    ``BUCKET_ROWS`` a row."""
    if not table.num_rows:
        return
    key = table.column("minimiser").to_numpy()
    part = (_finish(key.view(np.uint64)) % np.uint64(partitions)).astype(np.int64)
    order = np.lexsort((key, part))
    ends = np.cumsum(np.bincount(part, minlength=partitions))
    zstd, rows, held = pa.Codec("zstd", 3), [], 0
    for own, (start, end) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
        for at in range(start, end, BUCKET_ROWS):
            some = table.take(pa.array(order[at : min(at + BUCKET_ROWS, end)]))
            key, least, more = (some.column(c).to_numpy().astype("<i8") for c in ("minimiser", "least", "more"))
            data, offsets = buffers(some.column("packed"))
            parts = [key, np.diff(offsets).astype("<i8"), least, more, some.column("several").to_numpy().astype(np.uint8), data]
            raw = np.int64(len(key)).tobytes() + b"".join(x.tobytes() for x in parts)
            rows.append((own, len(raw), zstd.compress(raw, asbytes=True)))
            held += len(rows[-1][2])
            if held > BATCH_BYTES:
                yield pressed_rows(rows)
                rows, held = [], 0
    if rows:
        yield pressed_rows(rows)


def pressed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [f.split()[0] for f in PRESSED.split(", ")])


def unpress(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The super-k-mers of rows of ``PRESSED``."""
    zstd, tables, held = pa.Codec("zstd"), [], 0
    for size, pressed in zip(batch.column("size").to_pylist(), batch.column("pressed")):
        raw = np.frombuffer(zstd.decompress(pressed.as_buffer(), size), np.uint8)
        count = int(raw[:8].view("<i8")[0])
        key, lengths, least, more = raw[8 : 8 + 32 * count].view("<i8").reshape(4, count)
        several, data = raw[8 + 32 * count : 8 + 33 * count].astype(bool), raw[8 + 33 * count :]
        packed = strings(data, np.concatenate([[0], np.cumsum(lengths)]))
        tables.append(pa.table([pa.array(key), packed, pa.array(least), pa.array(several), pa.array(more)], PACKED))
        held += size
        if held > BATCH_BYTES:
            yield from pa.concat_tables(tables).combine_chunks().to_batches(BUCKET_ROWS)
            tables, held = [], 0
    if tables:
        yield from pa.concat_tables(tables).combine_chunks().to_batches(BUCKET_ROWS)


def _merge(table: pa.Table) -> pa.Table:
    """Equal super-k-mers as one row."""
    codes, distinct = encoded(table.column("packed").combine_chunks())
    if len(distinct) == table.num_rows:
        return table
    minimiser, least, several, more = (table.column(c).to_numpy() for c in ("minimiser", "least", "several", "more"))
    low = np.full(len(distinct), NO_ID)
    np.minimum.at(low, codes, least)
    key, total, others = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1), np.zeros(len(distinct), bool)
    key[codes] = minimiser
    np.add.at(total, codes, more + 1)
    np.logical_or.at(others, codes, several | (least != low[codes]))
    return pa.table([pa.array(key), distinct, pa.array(low), pa.array(others), pa.array(total)], PACKED)


def _answer(table: pa.Table, defer: bool = False) -> pa.RecordBatch:
    """What whole buckets tell of their super-k-mers: those in several documents, and the windows that
    a smaller id has too."""
    table = _merge(table)
    packed = table.column("packed").combine_chunks()
    least, others = table.column("least").to_numpy(), table.column("several").to_numpy()
    repeated: list[list[int]] = [[] for _ in range(table.num_rows)]
    _, inverse, count = np.unique(table.column("minimiser").to_numpy(), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[inverse] > 1)
    if len(several) and not defer:
        data, offsets = buffers(packed.take(pa.array(several)))
        body, bounds, by_text = words(data, offsets)
        codes, _ = encoded(strings(body, bounds))
        counts = np.diff(by_text) - WINDOW + 1
        at, row = spread_ranges(by_text[:-1], counts), np.repeat(np.arange(len(several)), counts)
        for w in np.flatnonzero(earlier(codes, at, np.zeros(len(at), np.int64), least[several][row])).tolist():
            repeated[several[row[w]]].append(int(at[w] - by_text[row[w]]))
    told = np.flatnonzero(others | np.array([bool(x) for x in repeated], bool) | defer)
    d1, d2 = digests([packed[i].as_py() for i in told.tolist()])
    lists = pa.array([repeated[i] for i in told.tolist()], pa.list_(pa.int32()))
    kept = packed.take(pa.array(told)) if defer else pa.nulls(len(told), pa.binary())
    numbers = [pa.array(x[told]) for x in (least, others, table.column("more").to_numpy() + 1)]
    return pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), *numbers, lists, kept], ["d1", "d2", "least", "several", "places", "repeated", "packed"])


def _buckets(rows: DataFrame, limit: int) -> DataFrame:
    """The answers of all buckets, each in one partition of ``rows``; one of more than ``limit`` bytes gives its
    strings back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, deferred = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            keys = table.column("minimiser").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            whole, held = table.slice(0, cut), _merge(table.slice(cut))
            if deferred is not None:
                own = int(np.searchsorted(keys[:cut], deferred, "right"))
                if own:
                    yield _answer(whole.slice(0, own), defer=True)
                whole = whole.slice(own)
            if whole.num_rows:
                yield _answer(whole)
            if held.column("packed").nbytes > limit or deferred == keys[-1]:
                yield _answer(held, defer=True)
                held, deferred = None, keys[-1]
        if held is not None:
            yield _answer(held)

    return rows.sortWithinPartitions("minimiser", "packed").mapInArrow(run, ANSWER)


def meet(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``values``, which has one row a key and says in ``places`` how many rows
    the key has. Keys with more than 1/``HOT`` of all rows are broadcast, fewer than ``HOT`` of them."""
    total = values.agg(F.sum("places")).first()[0] or 0
    values = values.withColumn("hot", F.col("places") * HOT > total)
    hot = F.broadcast(values.where("hot").drop("hot", "places"))
    rest = rows.join(F.broadcast(values.where("hot").select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(values.where("not hot").drop("hot", "places"), keys))


def _one_by_one(deferred: DataFrame) -> DataFrame:
    """Answers for the strings of buckets that were too large: by windows, each under its digest."""
    whole = deferred.groupBy("d1", "d2").agg(
        F.min("least").alias("least"), (F.bool_or("several") | (F.min("least") < F.max("least"))).alias("several"),
        F.sum("places").alias("places"), F.first("packed").alias("packed"),
    )
    whole = cut_lineage(whole, "large-buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row["packed"].split(b" ")
                count = len(own) - WINDOW + 1
                w1, w2 = digests([b" ".join(own[i : i + WINDOW]) for i in range(count)])
                same = [pa.array(np.full(count, row[c])) for c in ("d1", "d2", "least")]
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *same, pa.array(np.arange(count, dtype=np.int32))], ["w1", "w2", "d1", "d2", "least", "place"])

    windows = cut_lineage(whole.mapInArrow(run, "w1 long, w2 long, d1 long, d2 long, least long, place int"), "windows")
    first = cut_lineage(windows.groupBy("w1", "w2").agg(F.min("least").alias("first"), F.count("*").alias("places")).where("places > 1"), "first-windows")
    late = meet(windows, first, ["w1", "w2"]).where("least > first").groupBy("d1", "d2").agg(F.collect_list("place").alias("repeated"))
    return whole.drop("packed").join(late, ["d1", "d2"], "left")


def _places(source: DataFrame) -> DataFrame:
    """Where each super-k-mer stands: ``d1, d2, own, mark, start, size``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = buffers(batch.column("text"))
        ids, marks = batch.column("own").to_numpy(), batch.column("mark").to_numpy()
        parts = []
        for a, b in slices(offsets):
            packed, _, text, start, size = super_kmers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if packed:
                parts.append([*digests(packed), ids[a + text], marks[a + text], start, size])
        if not parts:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["d1", "d2", "own", "mark", "start", "size"])

    return map_arrow(source.select("own", "mark", "text"), run, "d1 long, d2 long, own long, mark long, start long, size long")


def _cleaned(joined: DataFrame, id_type: str, texts: bool) -> DataFrame:
    """The texts without the words of windows listed in ``late`` or repeated within the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        late = batch.column("late").to_pylist()
        counts, removed, digest, left = [], [], [], []
        for a, b in slices(offsets):
            body, bounds, by_text = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            codes = encoded(strings(body, bounds))[0] if len(bounds) > 1 else np.zeros(0, np.int64)
            number = np.diff(by_text)
            at = spread_ranges(by_text[:-1], np.maximum(number - WINDOW + 1, 0))
            row = np.repeat(np.arange(b - a), np.maximum(number - WINDOW + 1, 0))
            drop = np.zeros(len(codes) + 1, np.int64)
            again = at[earlier(codes, at, row, at)]
            np.add.at(drop, again, 1)
            np.add.at(drop, again + WINDOW, -1)
            for i, own in enumerate(late[a:b]):
                for window in own or ():
                    drop[by_text[i] + window["start"]] += 1
                    drop[by_text[i] + window["start"] + window["size"] + WINDOW - 1] -= 1
            kept = np.cumsum(drop[:-1]) == 0
            ends = np.append(0, np.cumsum(kept))[by_text]
            text, cuts = join_words(body, bounds, np.flatnonzero(kept), ends)
            counts.append(number)
            removed.append(number - np.diff(ends))
            digest += [hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(cuts[:-1], cuts[1:])]
            if texts:
                left += [text[i:j].tobytes().decode() for i, j in zip(cuts[:-1], cuts[1:])]
        columns = [batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.array(np.concatenate(removed)), pa.array(digest), pa.array(left, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts]
        return pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return map_arrow(joined, run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; with ``texts`` also ``kept_text``, the
    words that stay, joined by single blanks.

    A word goes if a window of 20 words that covers it also starts earlier: in a document with a
    smaller id (an integer), or further up in the same text. Windows are judged on the input. A null
    or empty text, or one of fewer than 20 words, loses nothing. Rows without an id come after all
    others. Rows of one id are documents of their own, and none of them is earlier than another, so
    repeated rows get equal results. Other columns are not read. An empty table gives an empty result.
    """
    source = _source(docs, id_col, text_col)
    answers = cut_lineage(_buckets(_combined(source), bucket_bytes), "super-k-mers")
    told = answers.where("packed is null").drop("packed")
    deferred = answers.where("packed is not null")
    if not deferred.isEmpty():
        told = cut_lineage(told.unionByName(_one_by_one(deferred).withColumn("repeated", F.coalesce("repeated", F.array().cast("array<int>")))), "answers")
    told = told.where("several or size(repeated) > 0").drop("several")
    places = cut_lineage(_places(source), "places")
    window = lambda start, size: F.struct(start.alias("start"), size.alias("size"))
    found = meet(places, told, ["d1", "d2"]).select(
        "own", "mark",
        F.when(F.col("own") > F.col("least"), F.array(window(F.col("start"), F.col("size"))))
        .otherwise(F.transform("repeated", lambda x: window(F.col("start") + x, F.lit(1).cast("long")))).alias("late"),
    )
    late = found.where("size(late) > 0").groupBy("own", "mark").agg(F.flatten(F.collect_list("late")).alias("late"))
    joined = source.join(late, ["own", "mark"], "left").select("doc_id", "text", "late")
    return _cleaned(joined, source.schema["doc_id"].dataType.simpleString(), texts)
