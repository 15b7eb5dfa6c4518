"""BPE encoding and decoding by speculation and verification (operator 4).

Greedy longest match proposes the tokens of every word, a bulk check tests all adjacent pairs, and
only words with a pair that cannot stand side by side are merged exactly.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vecmill.llm import bpe as B
from vecmill.llm.columnar import buffers, encoded, id_text, kept, map_arrow, slices, spread_ranges, strings
from vecmill.llm.transducer import pieces, unspaced_machine

# UTF-8 bytes of characters from U+0300 on start with 0xCC or more; U+0130 is 0xC4 0xB0.
SIMPLE_BELOW = 0xCC


def _seen(path: str) -> B.WordCache:
    return kept(("codec", path), B.WordCache)


def _normalize(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the tokenizer's normaliser leaves them, but for white space, which is dropped later.

    Simple lower-casing is the same for characters below U+0300 but U+0130; other texts go through
    the library's normaliser.
    """
    if not len(data):
        return data, offsets
    texts = pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )
    odd = data >= SIMPLE_BELOW
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
    lowered = pc.utf8_lower(texts)
    if len(rows):
        normalizer = B.library(path).normalizer
        whole = lowered.to_pylist()
        for row in rows.tolist():
            whole[row] = normalizer.normalize_str(texts[row].as_py())
        lowered = pa.array(whole, pa.large_string())
    return buffers(lowered)


def encode_texts(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts and their bounds, as the tokenizers library gives them without added
    special tokens."""
    bpe = B.load(path)
    data, bounds, parts, special = B.split_specials(data, offsets, bpe.specials)
    data, bounds = _normalize(path, data, bounds)
    data, cuts, by_text = pieces(unspaced_machine(), data, bounds, drop_space=True)
    ids, counts = np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
    if len(cuts) > 1:
        codes, distinct = encoded(strings(data, cuts))
        values, starts, lengths = _seen(path).look_up(distinct, lambda new: B.speculate_and_verify(bpe, new))
        sizes = lengths[codes]
        ids = values[spread_ranges(starts[codes], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = ends[by_text[1:]] - ends[by_text[:-1]]
    if (special >= 0).any():
        marked = np.flatnonzero(special >= 0)
        ids = np.insert(ids, np.cumsum(counts)[marked], special[marked])
        counts = counts + (special >= 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, ends[np.concatenate([[0], np.cumsum(parts)])]


@cache
def _token_text(path: str) -> pa.Array:
    return pa.array(B.load(path).text, pa.string())


def decode_ids(path: str, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The library's text of each run of ids: this vocabulary has no decoder, so tokens are joined by
    single blanks, and special tokens stay."""
    tokens = _token_text(path).take(pa.array(ids))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens), " ")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded`` of every whole text; one scan, no shuffle.

    A null or empty text has no ids and an empty decoded text. Repeated ids give repeated rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = [], []
        data, offsets = buffers(batch.column("text"))
        for a, b in slices(offsets):
            own, bounds = encode_texts(path, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(own)))
            texts.append(decode_ids(path, own, bounds))
        columns = [batch.column("doc_id"), pa.concat_arrays(ids), pa.concat_arrays(texts)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode`` gives, hashed in the task so
    that ids and decoded texts are not moved."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, decoded = [], [], []
        data, offsets = buffers(batch.column("text"))
        for a, b in slices(offsets):
            ids, bounds = encode_texts(path, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = memoryview(ids.astype("<u4").tobytes())
            counts.append(np.diff(bounds))
            hashes += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(bounds[:-1], bounds[1:])]
            text, ends = buffers(decode_ids(path, ids, bounds))
            decoded += [hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(ends[:-1], ends[1:])]
        columns = [batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.array(hashes), pa.array(decoded)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = id_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
