"""Standardisation by population deviation, for columns and for vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnScaler:
    """Means and deviations learnt on one table, applied to any other by expressions."""

    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(self.deviations[c] or 1.0) for c, m in self.means.items()}
        )


def fit_column_scaler(df: DataFrame, columns: Sequence[str]) -> ColumnScaler:
    """One pass for all columns; a constant column is only centred."""
    row = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return ColumnScaler(
        {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
        {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)},
    )


def fit_vector_scaler(df: DataFrame, vector: str, output: str) -> list[Transformer]:
    """ML stages that standardise each dimension of a vector column."""
    centred = f"{output}_centred"
    model = StandardScaler(withMean=True, withStd=False, inputCol=vector, outputCol=centred).fit(df)
    n = df.filter(F.col(vector).isNotNull()).count()
    shrink = math.sqrt((n - 1) / n) if n > 1 else 1.0  # sample deviation to population deviation
    factors = [1.0 / (s * shrink) if s > 0 else 1.0 for s in model.std.toArray()]
    return [model, ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol=centred, outputCol=output)]
