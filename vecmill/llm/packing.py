"""Hierarchical multi-length packing (operator 7).

Documents go to context-size tiers by length: whole windows of the longest tier first, the rest to
the smallest tier that holds it. Each tier is packed from the longest to the shortest: a piece opens
a window, and its gap is filled with the largest shorter pieces that fit, then with the head of a
piece that is cut. So every window is full. What is left at the end of a task is less than one window
of each tier; it is cut at powers of two, and such sequences need no padding.

Every task packs the documents that it reads, as they come, with a bounded number of open pieces: no
shuffle, no order between tasks, and a repeated task gives the same kind of result for its own rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vecmill.llm.codec import encode_texts
from vecmill.llm.columnar import bound_batches, buffers, id_text, slices, task_memory

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 16 * 4096
# Texts that are encoded at once: cutting words takes many times their bytes. Pieces are packed a slice at a time.
ENCODE_BYTES = 1 << 19
SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Packer:
    """Packs pieces ``(ids, doc_id, start, doc_tokens)``; emits rows of full windows."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.next_sequence = self.next_group = task << 40
        self.pools: dict[int, list[tuple[int, int, tuple]]] = {t: [] for t in self.tiers}
        self.ticket = 0
        self.groups: dict[int, tuple[int, int]] = {}
        self.rows: list[tuple] = []

    def add(self, ids: np.ndarray, doc_id) -> None:
        longest, total = self.tiers[-1], len(ids)
        whole = total - total % longest
        for start in range(0, whole, longest):
            self._emit([(ids[start : start + longest], doc_id, start, total)], longest)
        if whole < total:
            self._route((ids[whole:], doc_id, whole, total))

    def _route(self, piece: tuple) -> None:
        length = len(piece[0])
        tier = self.tiers[bisect.bisect_left(self.tiers, length)]
        self.ticket += 1
        bisect.insort(self.pools[tier], (length, self.ticket, piece))

    def _take(self, gap: int, tier: int) -> tuple | None:
        """A piece for a gap: the largest that fits, shorter tiers only; else the head of one."""
        below = self.tiers[: self.tiers.index(tier) + 1]
        for other in reversed(below):
            pool = self.pools[other]
            at = bisect.bisect_right(pool, (gap, self.ticket + 1)) - 1
            if at >= 0:
                return pool.pop(at)[2]
        for other in below:
            if self.pools[other]:
                ids, doc_id, start, total = self.pools[other].pop(0)[2]
                self._route((ids[gap:], doc_id, start + gap, total))
                return ids[:gap], doc_id, start, total
        return None

    def pack(self) -> None:
        """Fill windows as long as their tier and the shorter ones hold enough tokens."""
        for tier in reversed(self.tiers):
            below = self.tiers[: self.tiers.index(tier) + 1]
            held = sum(length for t in below for length, _, _ in self.pools[t])
            while self.pools[tier] and held >= tier:
                window, gap = [self.pools[tier].pop()[2]], tier
                gap -= len(window[0][0])
                while gap:
                    window.append(self._take(gap, tier))
                    gap -= len(window[-1][0])
                held -= tier
                self._emit(window, tier)

    def finish(self) -> None:
        self.pack()
        rest = [p for t in reversed(self.tiers) for _, _, p in self.pools[t]]
        left = sum(len(p[0]) for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                ids, doc_id, start, total = rest.pop(0)
                window.append((ids[:gap], doc_id, start, total))
                if len(ids) > gap:
                    rest.insert(0, (ids[gap:], doc_id, start + gap, total))
                gap -= len(window[-1][0])
            left -= size
            self._emit(window, size)

    def own_memory(self) -> None:
        """Copy the open pieces, so that they do not hold whole batches."""
        for tier, pool in self.pools.items():
            self.pools[tier] = [(n, k, (p[0].copy(), *p[1:])) for n, k, p in pool]

    def _emit(self, window: list[tuple], tier: int) -> None:
        group, filled = self.groups.get(tier, (-1, self.step_tokens))
        if filled >= self.step_tokens:
            group, filled = self.next_group, 0
            self.next_group += 1
        self.groups[tier] = (group, filled + tier)
        offset = 0
        for ids, doc_id, start, total in window:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.next_sequence, offset, tier, group))
            offset += len(ids)
        self.next_sequence += 1


def encoded_rows(path: str, data: np.ndarray, offsets: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text and ``end_id``; at most ``ENCODE_BYTES`` of texts, or one text, are encoded at once."""
    for a, b in slices(offsets, ENCODE_BYTES):
        ids, bounds = encode_texts(path, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
        for k in range(b - a):
            yield ids[bounds[k] : bounds[k + 1]]


def pack(
    docs: DataFrame,
    path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``: a
    document's ids are those of its text under the word vocabulary at ``path`` and ``end_id``. Ids
    of sequences are unique, not dense. ``tier`` is the sequence's length in tokens, always a power of
    two. ``step_group`` joins sequences of one tier, ``step_tokens`` tokens together. A null or empty
    text is its end id alone. Repeated rows are packed each for itself. Only the two columns are read.
    """
    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        id_type = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]])

        for batch in batches:
            id_type = batch.column("doc_id").type
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                for doc_id, ids in zip(doc_ids[a:b], encoded_rows(path, data, offsets[a : b + 1], end_id)):
                    packer.add(ids, doc_id)
                packer.pack()
                packer.own_memory()
                if packer.rows:
                    yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return source.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
