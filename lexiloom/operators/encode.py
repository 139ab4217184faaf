"""Text to vector over a table, with any encoder (V10), and token-table pooling (V8, V9)."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import safe_text
from lexiloom.functions.tokens import truncate, word_tokens
from lexiloom.functions.vectors import MIN_LENGTH

#: rows whose tokens are Python objects at one time
ROWS = 512


class Encoder(Protocol):
    """Turns lists of tokens into one vector each; ``id`` names all that shapes them."""

    id: str

    def encode(self, tokens: list[np.ndarray]) -> np.ndarray: ...


class HashEncoder:
    """Deterministic default: mean of signed unit vectors picked by a token's hash."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self.id = f"hash{dim}"

    def encode(self, tokens: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(t) for t in tokens])
        out = np.zeros((len(tokens), self.dim))
        if not lengths.sum():
            return out
        # by hash: an array of fixed-width strings would be as wide as the longest word, for every word
        inverse, unique = pd.factorize(np.concatenate([np.asarray(t, dtype=object) for t in tokens]))
        slots = np.array([self._slot(str(w)) for w in unique])
        rows = np.repeat(np.arange(len(tokens)), lengths)
        np.add.at(out, (rows, slots[inverse, 0].astype(int)), slots[inverse, 1])
        return out / np.maximum(lengths, MIN_LENGTH)[:, None]

    def _slot(self, word: str) -> tuple[int, float]:
        digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        return int.from_bytes(digest[:4]) % self.dim, 1.0 if digest[4] < 128 else -1.0


def worker_encoder(make: Callable[[], Encoder], encoder_id: str) -> Encoder:
    """One encoder per Python worker process, built by the first task that needs it."""
    shelf = sys.modules.setdefault("_lexiloom_encoders", types.ModuleType("_lexiloom_encoders")).__dict__
    if encoder_id not in shelf:
        shelf[encoder_id] = make()
    return shelf[encoder_id]


def encode_texts(
    df: DataFrame,
    key: str,
    text: str,
    encoder: Callable[[], Encoder] = HashEncoder,
    max_length: int = 128,
    encoder_id: str | None = None,
) -> DataFrame:
    """``key, vector``: the encoder is fed slices of Arrow batches, and with an ``encoder_id`` built once per worker.

    Tokens are cut to ``max_length`` before they cross to Python, as the encoder
    sees no more of them.
    """
    tokens = df.select(key, truncate(word_tokens(safe_text(text)), max_length).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_encoder(encoder, encoder_id) if encoder_id else encoder()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                lists = part.column(1).to_pylist()
                out = np.asarray(model.encode([np.array(t, dtype=object) for t in lists]), dtype=float)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[key, "vector"])

    return tokens.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, vector array<double>")


def pool_token_table(df: DataFrame, key: str, vector: str, mask: str, dim: int) -> DataFrame:
    """Masked mean over a long table of token vectors: one map-side combined aggregate per key."""
    zero = F.array_repeat(F.lit(0.0), F.lit(dim))
    seen = F.when(F.col(mask) == 1, F.col(vector).cast("array<double>")).otherwise(zero)
    pooled = df.select(key, F.col(mask), array_to_vector(seen).alias("v")).groupBy(key).agg(
        Summarizer.mean(F.col("v")).alias("m"),
        F.count(F.lit(1)).alias("n"),
        F.sum(mask).alias("w"),
    )
    scale = F.col("n") / F.greatest(F.col("w").cast("double"), F.lit(MIN_LENGTH))
    return pooled.select(key, F.transform(vector_to_array("m"), lambda x: x * scale).alias("vector"))


def first_token_table(df: DataFrame, key: str, vector: str, position: str) -> DataFrame:
    """Vector of the first token of each key."""
    return df.groupBy(key).agg(F.min_by(vector, position).alias("vector"))
