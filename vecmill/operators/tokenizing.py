"""Tokenising a text column to fixed length, with a vocabulary built from the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.functions import text as X
from vecmill.operators.batches import map_batches, with_elements
from vecmill.operators.ranking import global_rank
from vecmill.session import cut_lineage

# Terms that are broadcast when token ids are looked up: the most frequent ones, unless longer
# than a word can sensibly be, so 64 MB at worst. Ranks follow frequency, so a term beyond them
# holds less than 1/HEAD_TERMS of all tokens and is no hot key.
HEAD_TERMS = 1 << 18
HEAD_TERM_BYTES = 256


def tokenize(
    df: DataFrame, text_col: str = "text", max_length: int | None = X.MAX_LENGTH, pad: bool = True
) -> DataFrame:
    """Append ``tokens`` (framed, truncated and padded to ``max_length``), ``attention_mask`` and
    ``n_tokens``, the token count of the whole text without special tokens.

    ``max_length=None`` neither truncates nor pads. Map-only.
    """
    counted = df.withColumn("_tokens", X.tokens(text_col)).withColumn(
        "n_tokens", F.size("_tokens")
    )
    if max_length is None or not pad:
        result = counted.withColumn("tokens", X.framed(F.col("_tokens"), max_length))
        result = result.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("tokens")))
        return result.drop("_tokens")
    return (
        counted.withColumn("_framed", X.framed(F.col("_tokens"), max_length))
        .withColumn("tokens", X.padded(F.col("_framed"), F.lit(X.PAD), max_length))
        .withColumn("attention_mask", X.attention_mask(F.size("_framed"), max_length))
        .drop("_tokens", "_framed")
    )


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, n)`` over whole texts; counts are combined in each task before the shuffle."""
    return (
        df.select(F.explode(X.tokens(text_col)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def build_vocabulary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, n, token_id)``: ids follow the special ones, most frequent term first, ties by
    term. Every term of the corpus gets an id."""
    order = [F.col("n").desc(), F.col("token").asc()]
    ranked = global_rank(term_counts(df, text_col), order, "token_id")
    return ranked.withColumn("token_id", F.col("token_id") - 1 + len(X.SPECIAL_IDS))


def token_ids(
    df: DataFrame,
    vocabulary: DataFrame,
    id_col: str,
    text_col: str = "text",
    max_length: int = X.MAX_LENGTH,
) -> DataFrame:
    """``(id_col, input_ids, token_type_ids, attention_mask)``, each of ``max_length`` entries.

    ``id_col`` must be unique. Unknown terms become ``[UNK]``. Texts are read once, and neither they
    nor their tokens are moved: tasks look up the frequent terms and write the ids, with the terms
    that they did not find. Only these are joined with the rest of the vocabulary, and only the ids
    of texts that have some are put right. ``vocabulary`` is read twice, so pass a written one.
    """
    if max_length < 2:
        raise ValueError(f"max_length must leave room for two special tokens: {max_length}")
    lookup = vocabulary.select("token", F.col("token_id").cast("int"))
    head_end = HEAD_TERMS + len(X.SPECIAL_IDS)
    is_head = (F.col("token_id") < head_end) & (F.octet_length("token") <= HEAD_TERM_BYTES)
    head, tail = lookup.filter(is_head), lookup.filter(~is_head)
    texts = df.select(id_col, F.slice(X.tokens(text_col), 1, max_length - 2).alias("_tokens"))
    found = cut_lineage(_ids_in_tasks(texts, head), "head-ids")
    whole = found.filter(F.size("_rare") <= 0).select(id_col, "_body")
    bodies = whole.unionByName(_with_rare(found.filter(F.size("_rare") > 0), tail, id_col))

    special = {name: F.lit(number) for name, number in X.SPECIAL_IDS.items()}
    body = F.coalesce("_body", F.array().cast("array<int>"))
    framed = F.concat(F.array(special[X.CLS]), body, F.array(special[X.SEP]))
    return bodies.withColumn("_framed", framed).select(
        id_col,
        X.padded(F.col("_framed"), special[X.PAD], max_length).alias("input_ids"),
        F.array_repeat(F.lit(0), max_length).alias("token_type_ids"),
        X.attention_mask(F.size("_framed"), max_length).alias("attention_mask"),
    )


def _ids_in_tasks(texts: DataFrame, head: DataFrame) -> DataFrame:
    """``_body``, the ids of ``_tokens``, and ``_rare``, place and text of those not in ``head``,
    which has at most ``HEAD_TERMS`` short terms."""
    shared = texts.sparkSession.sparkContext.broadcast(head.toArrow().combine_chunks())
    unknown = X.SPECIAL_IDS[X.UNK]

    def look_up(batch: pa.Table) -> pa.Table:
        terms, ids = (shared.value[c].combine_chunks() for c in ("token", "token_id"))
        lists = batch["_tokens"].combine_chunks()
        flat = lists.flatten()
        found = ids.take(pc.index_in(flat, value_set=terms))
        bodies = with_elements(lists, pc.fill_null(found, unknown))
        missing = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        places = missing - starts[np.searchsorted(starts, missing, "right") - 1]
        entries = [pa.array(places, pa.int32()), flat.take(pa.array(missing, pa.int64())).cast(pa.string())]
        ends = pa.array(np.searchsorted(missing, starts), pa.int32())
        rare = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(entries, ["pos", "token"]))
        return batch.drop_columns("_tokens").append_column("_body", bodies).append_column("_rare", rare)

    return map_batches(texts, look_up)


def _with_rare(found: DataFrame, tail: DataFrame, id_col: str) -> DataFrame:
    """``_body`` with the ids of ``_rare`` terms that are in ``tail``; the others stay unknown."""
    rare = found.select(F.col(id_col).alias("_id"), F.inline("_rare"))
    entries = F.map_from_entries(F.collect_list(F.struct("pos", "token_id")))
    patches = rare.join(tail, "token").groupBy("_id").agg(entries.alias("_ids"))
    patched = found.join(patches, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    right = F.transform("_body", lambda old, pos: F.coalesce(F.try_element_at("_ids", pos), old))
    return patched.select(id_col, right.alias("_body"))
