"""Tokenizers compiled to finite-state transducers (operator 1: token counts).

Two machines in a row give the number of tokens of a text.

* The *border machine* reads character classes and marks where a piece of the tokenizer's split
  pattern begins. A transition carries two outputs: whether a piece begins at the character just
  read, and whether one began at the character before, where that had to wait for what follows.
* The *piece machine* reads the symbols of a piece. Its state is the prefix read so far, and the
  transition from one prefix to the next is annotated with the difference of their token counts.
  States are compiled when a piece first needs them: the last token of a prefix is the only one that
  ends there and is compatible with the last token of what stands before it.

Texts are cut into chunks of symbols without regard to their ends. Each chunk is read from all
states at once until they have met in one; the chunks' state maps are composed by a parallel prefix
scan, which gives each chunk the state that it begins in. So one long text costs no more than many.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm import bpe as B
from vecmill.llm.columnar import buffers, encoded, id_text, kept, map_arrow, segment_sum, slices, strings

CHUNK = 256
LONG_PIECE = 256
END = 11
KINDS = 12


class BorderMachine:
    """Transitions ``(state, class) -> (state, begins here, began one character ago)``."""

    def __init__(self, start: str, arcs: dict[str, dict[int, tuple[str, int, int]]]):
        names = list(arcs)
        self.start, self.states = names.index(start) * KINDS, len(names)
        self.next = np.zeros(self.states * KINDS, np.uint8)
        self.here, self.before = np.zeros(self.states * KINDS, bool), np.zeros(self.states * KINDS, bool)
        for i, name in enumerate(names):
            for kind, (to, here, before) in arcs[name].items():
                at = i * KINDS + kind
                self.next[at] = names.index(to) * KINDS
                self.here[at], self.before[at] = bool(here), bool(before)

    def run(self, kinds: np.ndarray) -> np.ndarray:
        """For each symbol, whether a piece begins there."""
        count = len(kinds)
        lanes = max(1, -(-count // CHUNK))
        padded = np.full(lanes * CHUNK, END, np.uint8)
        padded[:count] = kinds
        columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        state = self._scan(self._maps(columns))
        arcs = np.empty((CHUNK, lanes), np.uint8)
        for k in range(CHUNK):
            np.add(state, columns[k], out=arcs[k])
            state = self.next[arcs[k]]
        flat = np.ascontiguousarray(arcs.T).ravel()[:count]
        begins = self.here[flat]
        begins[:-1] |= self.before[flat[1:]]
        return begins

    def _maps(self, columns: np.ndarray) -> np.ndarray:
        """The state after each chunk, for each state before it."""
        state = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None] * KINDS, columns.shape[1], axis=1)
        for k in range(CHUNK):
            state = self.next[state + columns[k]]
            if len(state) > 1 and (state == state[0]).all():
                state = state[:1]
        return np.broadcast_to(state, (self.states, columns.shape[1]))

    def _scan(self, maps: np.ndarray) -> np.ndarray:
        """The state before each chunk: maps composed in log2(chunks) rounds."""
        total, step = np.ascontiguousarray(maps), 1
        while step < total.shape[1]:
            first = total[:, :-step] // KINDS
            joined = np.take_along_axis(total[:, step:], first, axis=0)
            total = np.concatenate([total[:, :step], joined], axis=1)
            step *= 2
        return np.concatenate([[np.uint8(self.start)], total[self.start // KINDS, :-1]]).astype(np.uint8)


C = B.Classes
LETTERS = (C.LETTER, C.S_T_M_D, C.R, C.V, C.E, C.L)


def _contractions(arcs: dict, after: dict[int, tuple[str, int, int]], done: str) -> None:
    """States after a quote that begins a piece: 's 't 'm 'd 're 've 'll are pieces of their own."""
    quote = {**after, **{k: ("other", 0, 0) for k in (C.OTHER, C.QUOTE)}, C.S_T_M_D: (done, 0, 0)}
    for kind, last in ((C.R, C.E), (C.V, C.E), (C.L, C.L)):
        name = f"quote{kind}"
        quote[kind] = (name, 0, 0)
        follow = {k: (to, here, 1) for k, (to, here, _) in {**after, **{k: ("letter", 0, 0) for k in LETTERS}}.items()}
        arcs[name] = {**follow, last: (done, 0, 0)}
    arcs["quote"] = quote


@cache
def spaced_machine() -> BorderMachine:
    """The pattern whose pieces take one leading blank."""
    fresh = {k: ("letter", 1, 0) for k in LETTERS} | {
        C.NUMBER: ("number", 1, 0), C.OTHER: ("other", 1, 0), C.QUOTE: ("quote", 1, 0),
        C.SPACE: ("blank", 1, 0), C.WHITE: ("white", 1, 0), END: ("start", 1, 0),
    }
    arcs = {"start": fresh, "done": fresh}
    arcs["letter"] = {**fresh, **{k: ("letter", 0, 0) for k in LETTERS}}
    arcs["number"] = {**fresh, C.NUMBER: ("number", 0, 0)}
    arcs["other"] = {**fresh, C.OTHER: ("other", 0, 0), C.QUOTE: ("other", 0, 0)}
    joined = {k: ("letter", 0, 0) for k in LETTERS} | {
        C.NUMBER: ("number", 0, 0), C.OTHER: ("other", 0, 0), C.QUOTE: ("other", 0, 0)}
    more = {C.SPACE: ("blanks", 0, 0), C.WHITE: ("whites", 0, 0)}
    late = lambda arcs: {k: (to, here, int(k not in (C.SPACE, C.WHITE, END))) for k, (to, here, _) in arcs.items()}
    arcs["blank"] = {**fresh, **joined, **more}
    arcs["blanks"] = late(arcs["blank"])
    arcs["white"] = {**fresh, **more}
    arcs["whites"] = late(arcs["white"])
    _contractions(arcs, fresh, "done")
    return BorderMachine("start", arcs)


@cache
def unspaced_machine() -> BorderMachine:
    """The pattern that drops white space and takes numbers one by one."""
    fresh = {k: ("letter", 1, 0) for k in LETTERS} | {
        C.NUMBER: ("start", 1, 0), C.OTHER: ("other", 1, 0), C.QUOTE: ("quote", 1, 0),
        C.SPACE: ("start", 1, 0), C.WHITE: ("start", 1, 0), END: ("start", 1, 0),
    }
    arcs = {"start": fresh, "letter": {**fresh, **{k: ("letter", 0, 0) for k in LETTERS}}}
    arcs["other"] = {**fresh, C.OTHER: ("other", 0, 0), C.QUOTE: ("other", 0, 0)}
    _contractions(arcs, fresh, "start")
    return BorderMachine("start", arcs)


def pieces(machine: BorderMachine, data: np.ndarray, offsets: np.ndarray, drop_space: bool):
    """Pieces of the texts: their bytes, bounds in these, and the texts' bounds in pieces."""
    points, starts = B.code_points(data)
    kinds = B.classes().of(points)
    heads = np.searchsorted(starts, offsets[:-1])
    at = np.arange(len(kinds)) + np.cumsum(np.bincount(heads, minlength=len(kinds) + 1))[: len(kinds)]
    with_ends = np.full(len(kinds) + len(heads), END, np.uint8)
    with_ends[at] = kinds
    begins = machine.run(with_ends)[at]
    if drop_space:
        kept = (kinds != C.SPACE) & (kinds != C.WHITE)
        widths = np.diff(np.append(starts, len(data)))
        first = np.flatnonzero(begins & kept)
        if not kept.all():
            data = data[np.repeat(kept, widths)]
        place = np.concatenate([[0], np.cumsum(np.where(kept, widths, 0))])
        bounds = np.append(place[first], place[-1])
        return data, bounds, np.searchsorted(starts[first], offsets)
    first = starts[begins]
    return data, np.append(first, len(data)), np.searchsorted(first, offsets)


def compile_counts(bpe: B.Bpe, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Run the piece machine over distinct pieces, compiling its states; tokens of each piece."""
    data = np.frombuffer(words.buffers()[2], np.uint8)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    symbols = bpe.symbols(data, bounds)
    lengths = np.diff(bounds)
    long = np.flatnonzero(lengths > LONG_PIECE)
    counts = np.ones(len(lengths), np.int32)
    total, last = np.zeros(len(symbols), np.int32), np.empty(len(symbols), np.int32)
    begin = np.repeat(bounds[:-1], lengths)
    by_end: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at, size, token in bpe.matches(symbols, bounds):
        by_end.append((at + size - 1, at, token))
    ends, starts, tokens = (np.concatenate(x) for x in zip(*by_end))
    # By place in the piece, then the longest token first.
    step = ends - begin[ends]
    order = np.lexsort((starts, ends, step))
    ends, starts, tokens, step = ends[order], starts[order], tokens[order], step[order]
    fresh = np.concatenate([[True], ends[1:] != ends[:-1]])
    group_at = np.flatnonzero(fresh)
    group_end = np.append(group_at[1:], len(ends))
    levels = np.searchsorted(step[group_at], np.arange(min(LONG_PIECE, int(step[-1]) + 1) + 1))
    for level in range(len(levels) - 1):
        now, stop = group_at[levels[level] : levels[level + 1]], group_end[levels[level] : levels[level + 1]]
        while len(now):
            end, start, token = ends[now], starts[now], tokens[now]
            ok = start == begin[end]
            inner = np.flatnonzero(~ok)
            ok[inner] = bpe.compatible(last[start[inner] - 1], token[inner])
            done = np.flatnonzero(ok)
            e, s = end[done], start[done]
            last[e] = token[done]
            total[e] = np.where(s == begin[e], 0, total[s - 1]) + 1
            now, stop = now[~ok] + 1, stop[~ok]
            if (now >= stop).any():
                raise ValueError("a prefix has no encoding under this vocabulary")
    counts = total[bounds[1:] - 1].astype(np.int32)
    for word in long.tolist():
        counts[word] = len(bpe._merge_long(symbols[bounds[word] : bounds[word + 1]]))
    return counts, np.ones(len(counts), np.int64)


def _seen(path: str) -> B.WordCache:
    return kept(("transducer", path), B.WordCache)


def count_texts(path: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text under the byte-level vocabulary at ``path``."""
    bpe = B.load(path)
    data, bounds, parts, special = B.split_specials(data, offsets, bpe.specials)
    data, cuts, by_text = pieces(spaced_machine(), data, bounds, drop_space=False)
    totals = np.zeros(len(bounds) - 1, np.int64)
    if len(cuts) > 1:
        codes, distinct = encoded(strings(data, cuts))
        values, starts, _ = _seen(path).look_up(distinct, lambda new: compile_counts(bpe, new))
        totals = segment_sum(values[starts][codes], by_text)
    totals = totals + (special >= 0)
    return segment_sum(totals, np.concatenate([[0], np.cumsum(parts)]))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; one scan, no shuffle.

    A null or empty text has no bytes and no tokens. Strings of special tokens inside a text count as
    the one token that the library makes of them. Repeated ids give repeated rows; other columns are
    not read. An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        counts = [
            count_texts(path, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for a, b in slices(offsets)
        ]
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.concatenate(counts))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = map_arrow(source, run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
