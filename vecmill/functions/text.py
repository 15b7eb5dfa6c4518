"""Text to tokens, and tokens to fixed-length model input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns (letters with their marks and digits form words; a model also sees
# each punctuation sign), the special tokens and the ids they take, the usual model input length.
WORD = r"[\p{L}\p{M}\p{N}]+"
WORD_OR_SIGN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIAL_IDS = {PAD: 0, UNK: 1, CLS: 2, SEP: 3}
MAX_LENGTH = 512


def words(text: str | Column) -> Column:
    """Lower-cased words in text order, as a search analyser sees them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: str | Column) -> Column:
    """Words and single signs in text order, case kept, as model input sees them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(WORD_OR_SIGN), F.lit(0))


def framed(toks: Column, max_length: int | None = MAX_LENGTH) -> Column:
    """``[CLS]`` tokens ``[SEP]``, truncated so that the whole has at most ``max_length``.

    ``None`` keeps every token.
    """
    if max_length is not None:
        if max_length < 2:
            raise ValueError(f"max_length must leave room for two special tokens: {max_length}")
        toks = F.slice(toks, 1, max_length - 2)
    return F.concat(F.array(F.lit(CLS)), toks, F.array(F.lit(SEP)))


def padded(values: Column, fill: Column, max_length: int = MAX_LENGTH) -> Column:
    """Append ``fill`` up to ``max_length`` entries."""
    return F.concat(values, F.array_repeat(fill, F.lit(max_length) - F.size(values)))


def attention_mask(length: Column, max_length: int = MAX_LENGTH) -> Column:
    """1 for the first ``length`` positions, 0 for padding."""
    return F.concat(
        F.array_repeat(F.lit(1), length), F.array_repeat(F.lit(0), F.lit(max_length) - length)
    )
