"""Byte-pair vocabularies of the public tokenizer files as arrays.

A word is a sequence of base symbols. A merged token has two parts, and its id grows with the rank
of its merge, as in the files used here (checked on loading). Two tokens may stand side by side in
an encoding exactly if merging their joined symbols gives the two tokens again; a sequence all of
whose neighbours may stand side by side is the encoding.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Regex, Tokenizer, pre_tokenizers

from vecmill.llm.columnar import spread_ranges

NONE = np.int32(-1)
MATRIX_SYMBOLS = 48
# A task keeps results of short words up to this size; an entry has a fixed part beside its bytes.
CACHE_BYTES = 24 << 20
CACHE_LONGEST = 64
CACHE_ENTRY = 150


class PairTable:
    """Pairs of small integers to an integer, open addressing, looked up in bulk."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        key = self._key(left, right)
        self.bits = max(8, int(np.ceil(np.log2(len(key) * 4 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            placed = rest[free][first]
            self.keys[at], self.values[at] = key[placed], value[placed]
            done = self.keys[slot] == key[rest]
            slot, rest = (slot[~done] + 1) & ((1 << self.bits) - 1), rest[~done]

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 20) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none; negative members have none."""
        key = self._key(left, right).ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return np.where((left < 0) | (right < 0), NONE, out.reshape(left.shape))


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class Bpe:
    """The vocabulary of one file; ``end`` is the suffix of a word's last symbol, or empty."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        # Symbols are bytes, and 256 + byte at the end of a word where that differs.
        self.symbol = np.array([vocab[c] for c in alphabet] + [vocab[c + self.end] for c in alphabet], np.int32)
        size = max(vocab.values()) + 1
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(size, *(i + 1 for i in self.specials.values()))
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.text = [""] * size
        for content, i in [*vocab.items(), *self.specials.items()]:
            self.text[i] = content
        parts = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int32)
        if (np.diff(parts[:, 2]) <= 0).any() or (parts[:, 2] <= parts[:, :2].max(axis=1)).any():
            raise ValueError("the ids of merged tokens must grow with their ranks")
        self.left[parts[:, 2]], self.right[parts[:, 2]] = parts[:, 0], parts[:, 1]
        self.merges = PairTable(parts[:, 0], parts[:, 1], parts[:, 2])
        self._build_trie(parts)

    def _build_trie(self, parts: np.ndarray) -> None:
        """A trie of all tokens over base symbols; ``accept[node]`` is the node's token."""
        spelled = {int(i): (int(i),) for i in self.symbol}
        for a, b, merged in parts.tolist():
            spelled[merged] = spelled[a] + spelled[b]
        self.longest = max(map(len, spelled.values()))
        children: dict[tuple[int, int], int] = {}
        accept = [-1]
        for token, symbols in spelled.items():
            node = 0
            for symbol in symbols:
                if (below := children.get((node, symbol))) is None:
                    below = children[node, symbol] = len(accept)
                    accept.append(-1)
                node = below
            accept[node] = token
        keys = np.array(list(children), np.int32)
        self.trie = PairTable(keys[:, 0], keys[:, 1], np.fromiter(children.values(), np.int32))
        self.accept = np.array(accept, np.int32)

    def symbols(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Base symbols of the words ``data[bounds[i]:bounds[i + 1]]``, none of them empty."""
        place = data.astype(np.int64)
        if self.end:
            place[bounds[1:] - 1] += 256
        return self.symbol[place]

    def matches(self, symbols: np.ndarray, bounds: np.ndarray):
        """All places where a token fits: rounds of (start, length, token), by growing length."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        at = np.arange(len(symbols))
        node = np.zeros(len(symbols), np.int32)
        length = 0
        while len(at):
            length += 1
            node = self.trie.get(node, symbols[at + length - 1])
            live = node >= 0
            token = np.where(live, self.accept[node], NONE)
            hit = token >= 0
            yield at[hit], length, token[hit]
            live &= at + length < ends[at]
            at, node = at[live], node[live]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined symbols of the two tokens gives the two tokens again.

        Undoes merges on both sides of the border, the latest first; a merge across the border that
        comes before the one undone last would have been made instead.
        """
        keys, inverse = np.unique((left.astype(np.int64) << 20) | right, return_inverse=True)
        a, b = (keys >> 20).astype(np.int32), (keys & ((1 << 20) - 1)).astype(np.int32)
        result = np.ones(len(keys), bool)
        open_ = np.arange(len(keys))
        limit = np.full(len(keys), np.iinfo(np.int32).max, np.int64)
        while len(open_):
            across = self.merges.get(a, b)
            bad = (across >= 0) & (across < limit)
            result[open_[bad]] = False
            split_a, split_b = self.right[a] != a, self.left[b] != b
            # Of equal tokens the left one is merged first, so the right one is undone first.
            take_a = split_a & (~split_b | (a > b))
            take_b = split_b & ~take_a
            limit = np.where(take_a, a, np.where(take_b, b.astype(np.int64) + 1, limit))
            a, b = np.where(take_a, self.right[a], a), np.where(take_b, self.left[b], b)
            live = ~bad & (take_a | take_b)
            open_, a, b, limit = open_[live], a[live], b[live], limit[live]
        return result[inverse]

    def merge_exact(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words by making the merges in order, and the number of tokens of each word."""
        lengths = np.diff(bounds)
        tokens: list[np.ndarray | None] = [None] * len(lengths)
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= MATRIX_SYMBOLS]
        for group in np.array_split(short, max(1, len(short) // 8192)):
            if len(group):
                self._merge_matrix(symbols, bounds, group, tokens)
        for word in order[len(short) :]:
            tokens[word] = self._merge_long(symbols[bounds[word] : bounds[word + 1]])
        counts = np.array([len(t) for t in tokens], np.int64)
        return (np.concatenate(tokens) if tokens else np.zeros(0, np.int32)), counts

    def _merge_matrix(self, symbols, bounds, group, tokens) -> None:
        lengths = bounds[group + 1] - bounds[group]
        width = int(lengths.max())
        column = np.arange(width)
        at = bounds[group][:, None] + column
        rows = np.where(column < lengths[:, None], symbols[np.minimum(at, len(symbols) - 1)], NONE)
        none = np.iinfo(np.int32).max
        names = group
        while len(names):
            across = self.merges.get(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.full((len(rows), 1), NONE)
            across = np.where(across < 0, none, across)
            place = across.argmin(axis=1)
            best = across[np.arange(len(rows)), place]
            done = best == none
            for name, row in zip(names[done].tolist(), rows[done]):
                tokens[name] = row[row >= 0]
            rows, names, place, best = rows[~done], names[~done], place[~done], best[~done]
            if len(names):
                rows[np.arange(len(rows)), place] = best
                source = np.arange(rows.shape[1] - 1) + (np.arange(rows.shape[1] - 1) > place[:, None])
                rows = np.take_along_axis(rows, source, axis=1)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: a heap of merges over a linked list."""
        tokens = symbols.tolist()
        after = [*range(1, len(tokens)), -1]
        before = list(range(-1, len(tokens) - 1))
        first = self.merges.get(symbols[:-1], symbols[1:]).tolist()
        heap = [(t, i) for i, t in enumerate(first) if t >= 0]
        heapq.heapify(heap)
        pairs = self.pair_dict()
        while heap:
            merged, i = heapq.heappop(heap)
            j = after[i] if tokens[i] >= 0 else -1
            if j < 0 or pairs.get((tokens[i], tokens[j])) != merged:
                continue
            tokens[i], tokens[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (t := pairs.get((merged, tokens[after[j]]))) is not None:
                    heapq.heappush(heap, (t, i))
            if before[i] >= 0 and (t := pairs.get((tokens[before[i]], merged))) is not None:
                heapq.heappush(heap, (t, before[i]))
        return np.array([t for t in tokens if t >= 0], np.int32)

    @cache
    def pair_dict(self) -> dict[tuple[int, int], int]:
        merged = np.flatnonzero(self.left != np.arange(len(self.left)))
        return {(int(self.left[m]), int(self.right[m])): int(m) for m in merged}


class WordCache:
    """Results of words seen before, of at most ``CACHE_BYTES`` in all; then it starts anew. Words of
    more than ``CACHE_LONGEST`` bytes are not kept."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.values = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.bytes = 0

    def look_up(self, wanted: pa.Array, compute) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, start, length) of each distinct word in ``wanted``; ``compute(words)`` gives the
        values and counts of unknown words."""
        if self.bytes > CACHE_BYTES:
            self.__init__()
        spelled = wanted.to_pylist()
        place = np.fromiter((self.place.get(w, -1) for w in spelled), np.int64, len(spelled))
        missing = np.flatnonzero(place < 0)
        if not len(missing):
            return self.values, self.starts[place], self.lengths[place]
        values, counts = compute(wanted.take(pa.array(missing)))
        all_values = np.concatenate([self.values, values])
        starts, lengths = np.empty(len(spelled), np.int64), np.empty(len(spelled), np.int64)
        known = place >= 0
        starts[known], lengths[known] = self.starts[place[known]], self.lengths[place[known]]
        starts[missing], lengths[missing] = len(self.values) + np.cumsum(counts) - counts, counts
        short = missing[np.array([len(spelled[i]) <= CACHE_LONGEST for i in missing.tolist()])]
        own = spread_ranges(starts[short], lengths[short])
        ends = np.cumsum(lengths[short])
        self.place.update(zip([spelled[i] for i in short.tolist()], range(len(self.starts), len(self.starts) + len(short))))
        self.starts = np.concatenate([self.starts, len(self.values) + ends - lengths[short]])
        self.lengths = np.concatenate([self.lengths, lengths[short]])
        self.values = np.concatenate([self.values, all_values[own]])
        self.bytes += sum(len(spelled[i]) + CACHE_ENTRY for i in short.tolist()) + 4 * len(own)
        return all_values, starts, lengths


class Classes:
    """Character classes of code points, as the tokenizer library's own patterns see them."""

    def __init__(self):
        self.table = self._probe(np.arange(0x300, dtype=np.uint32))
        self.rare: dict[int, int] = {}

    # Classes of characters.
    OTHER, SPACE, WHITE, LETTER, NUMBER, QUOTE, S_T_M_D, R, V, E, L = range(11)

    @classmethod
    def _probe(cls, points: np.ndarray) -> np.ndarray:
        text = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
        out = np.full(len(points), cls.OTHER, np.uint8)
        for kind, pattern in ((cls.WHITE, r"\s"), (cls.LETTER, r"\p{L}"), (cls.NUMBER, r"\p{N}")):
            rest = np.ones(len(points), bool)
            split = pre_tokenizers.Split(Regex(pattern), "removed")
            for _, (start, end) in split.pre_tokenize_str(text):
                rest[start:end] = False
            out[rest] = kind
        for kind, chars in ((cls.SPACE, " "), (cls.QUOTE, "'"), (cls.S_T_M_D, "stmd"), (cls.R, "r"), (cls.V, "v"), (cls.E, "e"), (cls.L, "l")):
            for char in chars:
                out[points == ord(char)] = kind
        return out

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(points, 0x2FF)]
        high = np.flatnonzero(points >= 0x300)
        if len(high):
            distinct, inverse = np.unique(points[high], return_inverse=True)
            new = np.array([p for p in distinct.tolist() if p not in self.rare], np.uint32)
            if len(new):
                self.rare.update(zip(new.tolist(), self._probe(new).tolist()))
            out[high] = np.array([self.rare[p] for p in distinct.tolist()], np.uint8)[inverse]
        return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the place of each one's first byte."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts]
    points = lead.astype(np.uint32)
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        at, first = starts[wide], points[wide]
        one, two, three = (padded[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        points[wide] = np.where(
            first < 0xE0,
            (first & 0x1F) << 6 | one,
            np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three),
        )
    return points, starts


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


@cache
def classes() -> Classes:
    return Classes()


@cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def split_specials(data: np.ndarray, offsets: np.ndarray, specials: dict[str, int]):
    """Cut texts at special tokens, which the library finds first of all.

    Returns the remaining bytes, the bounds of the pieces, the number of pieces of each text, and the
    special id that follows each piece (-1: none).
    """
    rows = len(offsets) - 1
    plain = np.ones(rows, np.int64)
    rare: dict[int, list] = {}
    marks = np.flatnonzero(data[:-1] == ord("<")) if len(data) else np.zeros(0, np.int64)
    for row in np.unique(np.searchsorted(offsets, marks[data[marks + 1] == ord("|")], "right") - 1).tolist():
        text = data[offsets[row] : offsets[row + 1]].tobytes()
        pieces = []
        while True:
            hits = [(text.find(s.encode()), -len(s), s) for s in specials]
            at, _, special = min((h for h in hits if h[0] >= 0), default=(-1, 0, ""))
            if at < 0:
                break
            pieces.append((text[:at], specials[special]))
            text = text[at + len(special.encode()) :]
        if pieces:
            rare[row] = [*pieces, (text, -1)]
    if not rare:
        return data, offsets, plain, np.full(rows, -1, np.int64)
    parts, bounds, after, last = [], [0], [], 0
    for row in sorted(rare):
        parts.append(data[offsets[last] : offsets[row]])
        bounds += (offsets[last + 1 : row + 1] - offsets[last] + bounds[-1]).tolist()
        after += [-1] * (row - last)
        for text, special in rare[row]:
            parts.append(np.frombuffer(text, np.uint8))
            bounds.append(bounds[-1] + len(text))
            after.append(special)
        plain[row], last = len(rare[row]), row + 1
    parts.append(data[offsets[last] :])
    bounds += (offsets[last + 1 :] - offsets[last] + bounds[-1]).tolist()
    after += [-1] * (rows - last)
    return np.concatenate(parts), np.array(bounds, np.int64), plain, np.array(after, np.int64)


def greedy(bpe: Bpe, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest token from the left, again and again: tokens and their number for each word."""
    token, length = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int64)
    for at, size, found in bpe.matches(symbols, bounds):
        token[at], length[at] = found, size
    chosen = np.zeros(len(symbols), bool)
    at, word = bounds[:-1].copy(), np.arange(len(bounds) - 1)
    while len(at):
        chosen[at] = True
        at = at + length[at]
        live = at < bounds[word + 1]
        at, word = at[live], word[live]
    counts = np.concatenate([[0], np.cumsum(chosen)])
    return token[chosen], counts[bounds[1:]] - counts[bounds[:-1]]


def speculate_and_verify(bpe: Bpe, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of distinct words: a greedy proposal, kept where all neighbours are compatible; the
    other words are merged exactly."""
    data = np.frombuffer(pieces.buffers()[2], np.uint8)
    bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    symbols = bpe.symbols(data, bounds)
    tokens, counts = greedy(bpe, symbols, bounds)
    ends = np.cumsum(counts)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    pair = np.flatnonzero(inner)
    wrong = pair[~bpe.compatible(tokens[pair], tokens[pair + 1])]
    failed = np.unique(np.searchsorted(ends, wrong, "right"))
    if not len(failed):
        return tokens, counts
    lengths = np.diff(bounds)[failed]
    own = np.concatenate([[0], np.cumsum(lengths)])
    exact, exact_counts = bpe.merge_exact(symbols[spread_ranges(bounds[failed], lengths)], own)
    new_counts = counts.copy()
    new_counts[failed] = exact_counts
    out = np.empty(int(new_counts.sum()), np.int32)
    new_starts = np.cumsum(new_counts) - new_counts
    kept = np.setdiff1d(np.arange(len(counts)), failed, assume_unique=True)
    out[spread_ranges(new_starts[kept], counts[kept])] = tokens[spread_ranges((ends - counts)[kept], counts[kept])]
    out[spread_ranges(new_starts[failed], exact_counts)] = exact
    return out, new_counts

