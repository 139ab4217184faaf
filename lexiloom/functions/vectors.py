"""Vector expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: lowest token count a mean is divided by.
MIN_LENGTH = 1e-9


def to_float(vector: Column) -> Column:
    return vector.cast("array<float>")


def concat_vectors(*vectors: Column) -> Column:
    return F.concat(*[v.cast("array<double>") for v in vectors])


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask is set: one pass inside the row."""
    zero = F.array_repeat(F.lit(0.0), F.lit(dim))
    weighted = F.zip_with(
        vectors,
        mask,
        lambda v, m: F.struct(v.cast("array<double>").alias("v"), m.cast("double").alias("m")),
    )
    total = F.aggregate(
        weighted,
        zero,
        lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b * x["m"]),
    )
    weight = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double"))
    return F.transform(total, lambda s: s / F.greatest(weight, F.lit(MIN_LENGTH)))


def first_token(vectors: Column) -> Column:
    return F.try_element_at(vectors, F.lit(1))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    shifted = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(shifted, lambda e: e / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the highest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
