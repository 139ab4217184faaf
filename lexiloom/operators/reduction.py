"""PCA on standardised vectors (V5)."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame

from lexiloom.operators.scaling import fit_vector_scaler


def fit_pca(df: DataFrame, vector: str, output: str, k: int) -> list[Transformer]:
    """Stages that scale, project to k components and fix each sign.

    The largest loading of a component is positive. A smaller k is a prefix of
    the output, so one fit serves a whole grid of sizes.
    """
    scaled, raw = f"{output}_scaled", f"{output}_raw"
    scaler = fit_vector_scaler(df, vector, scaled)
    model = PCA(k=k, inputCol=scaled, outputCol=raw).fit(PipelineModel(scaler).transform(df))
    loadings = model.pc.toArray()
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    signs = Vectors.dense(np.where(top < 0, -1.0, 1.0))
    return [*scaler, model, ElementwiseProduct(scalingVec=signs, inputCol=raw, outputCol=output)]


def correlation_matrix(df: DataFrame, vector: str) -> np.ndarray:
    """Covariance of the standardised dimensions: d x d numbers, whatever the row count."""
    return Correlation.corr(df, vector).first()[0].toArray()
