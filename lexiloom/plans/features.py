"""Feature stages that end in one ``features`` vector (V3, V4, M7)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.clean import bool_to_int, clean_number, list_length
from lexiloom.functions.text import safe_text
from lexiloom.operators.reduction import fit_pca
from lexiloom.operators.scaling import fit_vector_scaler
from lexiloom.operators.tfidf import LARGE, SMALL, TermRules, fit_tfidf
from lexiloom.plans.places import fit_places

FEATURES = "features"
MISSING_LEVEL = "\u0000missing"


@dataclass(frozen=True)
class Inputs:
    """Which columns of a table play which part; the key never becomes a feature."""

    key: str
    label: str = "label"
    text: str | None = None
    numbers: tuple[str, ...] = ()
    category: str | None = None
    vector: str | None = None

    def columns(self) -> list[str]:
        parts = [self.text, *self.numbers, self.category, self.vector]
        return [self.key, *dict.fromkeys(p for p in parts if p)]


def prepare(df: DataFrame, inputs: Inputs) -> DataFrame:
    """Repair the input columns, row by row: what the models see is the cleaned table."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def repaired(name: str):
        c, kind = F.col(f"`{name}`"), types[name]
        if name in inputs.numbers:
            if isinstance(kind, T.BooleanType):
                c = bool_to_int(c)
            elif isinstance(kind, T.ArrayType):
                c = list_length(c)
            else:
                c = clean_number(c, isinstance(kind, (T.DoubleType, T.FloatType)))
            return c.cast("double").alias(name)
        if name == inputs.text:
            return safe_text(c).alias(name)
        if name == inputs.category:
            return F.coalesce(c, F.lit(MISSING_LEVEL)).alias(name)
        if name == inputs.vector and not isinstance(kind, VectorUDT):
            return array_to_vector(c).alias(name)
        return c

    extra = [c for c in (inputs.label, "fold", "split") if c in df.columns]
    return df.select(*[repaired(c) for c in dict.fromkeys([*inputs.columns(), *extra])])


def text_stages(train: DataFrame, inputs: Inputs, rules: TermRules = SMALL) -> list[Transformer]:
    return fit_tfidf(train, inputs.text, rules).stages(inputs.text, FEATURES)


def number_stages(train: DataFrame, inputs: Inputs, output: str) -> list[Transformer]:
    """Standardised numbers as one vector."""
    assembled = VectorAssembler(inputCols=list(inputs.numbers), outputCol=f"{output}_raw")
    return [assembled, *fit_vector_scaler(assembled.transform(train), f"{output}_raw", output)]


def category_stages(train: DataFrame, inputs: Inputs, output: str) -> list[Transformer]:
    """One slot per level seen in train, however many; the slot of unknown levels is the one dropped."""
    index = f"{output}_index"
    levels = StringIndexer(inputCol=inputs.category, outputCol=index, stringOrderType="alphabetAsc", handleInvalid="keep")
    indexer = levels.fit(train)
    encoder = OneHotEncoder(inputCol=index, outputCol=output, dropLast=True)
    return [indexer, encoder.fit(indexer.transform(train))]


def metadata_stages(train: DataFrame, inputs: Inputs) -> tuple[list[Transformer], list[str]]:
    stages: list[Transformer] = []
    outputs: list[str] = []
    if inputs.numbers:
        stages += number_stages(train, inputs, "meta_numbers")
        outputs.append("meta_numbers")
        stages.append(VectorSizeHint(inputCol="meta_numbers", size=len(inputs.numbers), handleInvalid="optimistic"))
    if inputs.category:
        stages += category_stages(train, inputs, "meta_levels")
        outputs.append("meta_levels")
    return stages, outputs


def text_metadata_stages(train: DataFrame, inputs: Inputs, rules: TermRules = LARGE) -> list[Transformer]:
    """TF-IDF, standardised numbers and levels side by side; other columns are left out."""
    model = fit_tfidf(train, inputs.text, rules)
    meta, outputs = metadata_stages(train, inputs)
    return [
        *model.stages(inputs.text, "text_features"),
        VectorSizeHint(inputCol="text_features", size=len(model.terms), handleInvalid="optimistic"),
        *meta,
        VectorAssembler(inputCols=["text_features", *outputs], outputCol=FEATURES),
    ]


def vector_metadata_stages(
    train: DataFrame, inputs: Inputs, components: int | None = None, layout: int | None = None, **options: Any
) -> list[Transformer]:
    """Standardised vectors, their first principal components, or a layout of so many dimensions, next to the metadata."""
    size = components or layout or vector_size(train, inputs.vector)
    if layout is not None:
        scaled = fit_vector_scaler(train, inputs.vector, "vector_scaled")
        stages = [*scaled, fit_places(apply(scaled, train), "vector_scaled", "vector_features", layout, **options)]
    elif components is None:
        stages = fit_vector_scaler(train, inputs.vector, "vector_features")
    else:
        stages = fit_pca(train, inputs.vector, "vector_features", components)
    meta, outputs = metadata_stages(train, inputs)
    return [
        *stages,
        VectorSizeHint(inputCol="vector_features", size=size, handleInvalid="optimistic"),
        *meta,
        VectorAssembler(inputCols=["vector_features", *outputs], outputCol=FEATURES),
    ]


def first_components(column: str, output: str, k: int) -> Transformer:
    """The k leading entries: PCA of size k out of a larger one."""
    return VectorSlicer(inputCol=column, outputCol=output, indices=list(range(k)))


def vector_size(df: DataFrame, column: str) -> int:
    return df.filter(F.col(column).isNotNull()).select(column).first()[0].size


def apply(stages: list[Transformer], df: DataFrame) -> DataFrame:
    return PipelineModel(stages).transform(df)
