"""Word tokens as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of at least two letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def word_tokens(text: str | Column) -> Column:
    """Lower-cased word tokens; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Tokens not in the list. ``isin`` on literals is one hash-set probe per token."""
    words = list(stop_words)
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def truncate(tokens: Column, max_length: int) -> Column:
    """The first ``max_length`` tokens, as an encoder sees them."""
    return F.slice(tokens, 1, max_length)
