"""Periodic runs of words by recursive frequency splitting (operator 13).

A run repeats its period four times or more, so each of its words occurs at least four times in any
segment that holds the run. Words that are rarer within their segment split it; the pieces are split
again by their own counts until nothing changes. Most prose is gone after a few rounds.

The surviving segments are scanned lag by lag. A run of period q holds three equal blocks of q words
that begin at a multiple of q within the segment, so each lag looks only at these places, by prefix
hashes; what it finds is extended and confirmed word by word. Lags grow, so a stretch whose smallest
period is another one lies in a run that is already known. All texts of a slice go through each step
together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.columnar import buffers, encoded, map_arrow, slices, spread_ranges, strings, words

MIN_LENGTH = 6
MIN_EXPONENT = 4
BASE = np.uint64(0x9E3779B97F4A7C15)
NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]


def planted(marks: list[int | None], by_text: np.ndarray) -> np.ndarray:
    """For each word place the word that stands there: every tenth text, by the checksum of its id,
    repeats a stretch of its words from some place to its end."""
    source = np.arange(by_text[-1])
    for row, mark in enumerate(marks):
        first, n = int(by_text[row]), int(by_text[row + 1] - by_text[row])
        if mark is not None and mark % 10 == 0 and n:
            g = mark // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            source[first + a : first + n] = first + a + np.arange(n - a) % period
    return source


def split_segments(codes: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the segments in which every word occurs ``MIN_EXPONENT`` times or more."""
    base = int(codes.max()) + 1 if len(codes) else 1
    at, segment = np.arange(len(codes)), np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
    starts, lengths = [], []
    while len(at):
        _, inverse, count = np.unique(segment * base + codes[at], return_inverse=True, return_counts=True)
        frequent = count[inverse] >= MIN_EXPONENT
        _, segment = np.unique(segment, return_inverse=True)
        split = np.bincount(segment, ~frequent) > 0
        head = np.append(True, segment[1:] != segment[:-1])
        whole = np.flatnonzero(~split)
        size = np.bincount(segment)
        starts.append(at[head][whole])
        lengths.append(size[whole])
        # Only segments that were split go on, as the stretches of words that are left in them.
        left = frequent & split[segment]
        at, segment = at[left], segment[left]
        if len(at):
            head = np.append(True, (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1]))
            segment = np.cumsum(head) - 1
            enough = np.bincount(segment)[segment] >= MIN_LENGTH
            at, segment = at[enough], segment[enough]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lengths = np.concatenate(starts), np.concatenate(lengths)
    long = lengths >= MIN_LENGTH
    return starts[long], lengths[long]


def _stretch(codes: np.ndarray, lag: int, low: int, high: int, at: int) -> tuple[int, int]:
    """The longest stretch around ``at`` within ``low .. high`` whose words equal those ``lag`` on."""
    end, step = at, 64
    while end < high - lag:
        stop = min(end + step, high - lag)
        differ = codes[end:stop] != codes[end + lag : stop + lag]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, 2 * step
    start, step = at, 64
    while start > low:
        stop = max(start - step, low)
        differ = codes[stop:start] != codes[stop + lag : start + lag]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = stop, 2 * step
    return start, end + lag


def scan_lags(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of the segments."""
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    # The segments alone, one after the other, the longest first.
    place = spread_ranges(starts[order], lengths)
    own = codes[place]
    low = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(own), BASE)), dtype=np.uint64)
        mixed = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        prefix = np.append(np.uint64(0), np.cumsum(mixed * powers[:-1], dtype=np.uint64))
    reach = np.zeros(len(own), np.int64)
    runs = []
    for lag in range(1, int(lengths[0]) // MIN_EXPONENT + 1 if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -max(MIN_LENGTH, MIN_EXPONENT * lag), "right"))
        count = lengths[:active] // lag - 2
        ends = np.cumsum(count)
        at = np.repeat(low[:active] - lag * (ends - count), count) + lag * np.arange(int(ends[-1]))
        block = prefix[at + lag] - prefix[at]
        after = prefix[at + 2 * lag] - prefix[at + lag]
        hit = np.flatnonzero(block * powers[lag] == after)
        if len(hit):
            at, after = at[hit], after[hit]
            third = prefix[at + 3 * lag] - prefix[at + 2 * lag]
            at = at[(after * powers[lag] == third) & (reach[at] < at + 2 * lag)]
            segment = np.searchsorted(low, at, "right") - 1
            for i, s in zip(at.tolist(), segment.tolist()):
                if reach[i] >= i + 2 * lag:
                    continue
                start, end = _stretch(own, lag, int(low[s]), int(low[s] + lengths[s]), i)
                if end - start >= max(MIN_LENGTH, MIN_EXPONENT * lag):
                    reach[start:end] = np.maximum(reach[start:end], end)
                    runs.append((int(place[start]), end - start, lag))
    return runs


def find_runs(codes: np.ndarray, by_text: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, ``(start, length, period)`` in words of the text, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(by_text) - 1)]
    starts, lengths = split_segments(codes, by_text)
    for start, length, period in scan_lags(codes, starts, lengths):
        row = int(np.searchsorted(by_text, start, "right")) - 1
        found[row].append((start - int(by_text[row]), length, period))
    for own in found:
        own.sort(key=lambda run: (run[0], run[2]))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; of equal ones the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def join_words(body: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts made of the words ``chosen``, joined by single blanks."""
    taken = strings(body, bounds).take(pa.array(chosen)) if len(chosen) else pa.array([], pa.binary())
    lists = pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), taken)
    return buffers(pc.binary_join(lists, pa.scalar(b" ", pa.binary())))


def collapse(marks: list[int | None], data: np.ndarray, offsets: np.ndarray):
    """Runs of each text, and the bytes and offsets of the texts without the repeated words."""
    body, bounds, by_text = words(data, offsets)
    codes = encoded(strings(body, bounds))[0] if len(bounds) > 1 else np.zeros(0, np.int64)
    source = planted(marks, by_text)
    runs = find_runs(codes[source], by_text)
    change = np.zeros(len(source) + 1, np.int64)
    for row, own in enumerate(runs):
        for start, length, period in own:
            change[by_text[row] + start + period] += 1
            change[by_text[row] + start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    ends = np.append(0, np.cumsum(kept))[by_text]
    return runs, *join_words(body, bounds, source[kept], ends)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of
    every whole text; one scan, no shuffle.

    The single columns tell of the strongest run. With ``texts`` the columns ``runs`` (all runs as
    ``start,length,period``, one a line) and ``collapsed`` (the text without the words that only
    repeat) follow, of which the digests are. A null or empty text, or one without words, has no runs
    and collapses to nothing. A text whose id is null is taken as it is. Repeated ids are read row by
    row; other columns are not read. An empty table gives an empty result.
    """
    names = NAMES if texts else NAMES[:8]
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.crc32(F.col(id_col).cast("string")).alias("mark")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        marks = batch.column("mark").to_pylist()
        best, counts, listed, digests, left = [], [], [], [], []
        for a, b in slices(offsets):
            runs, text, ends = collapse(marks[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for own in runs:
                counts.append(len(own))
                best.append(strongest(own) or (None, None, None))
                listed.append("".join(f"{s},{n},{p}\n" for s, n, p in own))
            digests += [hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(ends[:-1], ends[1:])]
            if texts:
                left += [text[i:j].tobytes().decode() for i, j in zip(ends[:-1], ends[1:])]
        start, length, period = zip(*best)
        milli = [None if n is None else 1000 * n // p for n, p in zip(length, period)]
        columns = [
            batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (counts, start, length, period, milli)],
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]), pa.array(digests), pa.array(listed), pa.array(left, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns[: len(names)], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in NAMES[1:6])
    return map_arrow(source, run, f"doc_id {kind}, {numbers}, " + ", ".join(f"{c} string" for c in names[6:]))
